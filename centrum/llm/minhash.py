"""Near-duplicates by circulant MinHash: bands propose, exact Jaccard similarity on whole shingle sets decides."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from centrum.llm.common import held, slices, stored, texts_of
from centrum.llm.components import components

#: Positions that shingles are permuted over; two shingles on one position can only add candidates.
DOMAIN = 1 << 20
COORDINATES = 192
#: Up to so many ids with candidates (some 30 MB) are broadcast, so that other texts aren't shuffled; more are joined.
BROADCAST_IDS = 1_000_000
#: Central nodes of a bucket that its members are compared with, round by round.
CENTRES = (1, 4, 16)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@lru_cache(maxsize=1)
def _permuted() -> np.ndarray:
    """The second permutation, with its beginning repeated at its end: the shift by k is a slice that begins k later."""
    values = np.random.default_rng(20240607).permutation(DOMAIN).astype(np.uint32)
    return np.concatenate([values, values[:COORDINATES]])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    """64-bit hashes of words, computed once while the table lives."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_words = _WordHashes()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words; of the whole sequence if it is shorter; none without words."""
    if len(_words) > 200_000:
        _words.clear()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mixed(out * _MIX[0] + h[k : k + len(out)])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates at once: a shingle's first permutation picks a place, and the slice from there on is its circulant row."""
    table = np.lib.stride_tricks.sliding_window_view(_permuted(), COORDINATES)
    places = (_mixed(shingles + _MIX[0]) & np.uint64(DOMAIN - 1)).astype(np.int64)
    out = np.full(COORDINATES, DOMAIN, np.uint32)
    for i in range(0, len(places), 512):
        np.minimum(out, table[places[i : i + 512]].min(axis=0), out=out)
    return out


def bands_for(similarity: float, miss: float = 1e-6) -> tuple[int, int]:
    """Rows a band and number of bands: as many rows as leave a linked pair at most ``miss`` to share no band."""
    for rows in range(12, 0, -1):
        bands = COORDINATES // rows
        if (1 - similarity**rows) ** bands <= miss:
            return rows, bands
    return 1, COORDINATES


def _band_hashes(signed: np.ndarray, rows: int, bands: int) -> np.ndarray:
    cut = signed[: rows * bands].reshape(bands, rows).astype(np.uint64)
    out = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        out = _mixed(out * _MIX[0] + cut[:, k])
    return out.view(np.int64)


def _words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().lower().split()


def _signed(df: DataFrame, kind: str, size: int, rows: int, bands: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in slices(texts):
                counts, digests, hashes = [], [], []
                for text in texts[a:b]:
                    words = _words_of(text)
                    shingles = shingle_hashes(words, size)
                    counts.append(len(shingles))
                    digests.append(hashlib.md5(b" ".join(words)).digest() if words else None)
                    hashes.append(_band_hashes(signature(shingles), rows, bands) if words else [])
                out = {"id": batch.column(0).slice(a, b - a), "n": pa.array(counts, pa.int64()), "digest": pa.array(digests, pa.binary())}
                yield pa.RecordBatch.from_pydict(out | {"bands": pa.array(hashes, pa.list_(pa.int64()))})

    return df.mapInArrow(run, f"id {kind}, n long, digest binary, bands array<long>")


def _sets(df: DataFrame, kind: str, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in slices(texts):
                found = [shingle_hashes(_words_of(t), size).view(np.int64) for t in texts[a:b]]
                yield pa.RecordBatch.from_pydict({"node": batch.column(0).slice(a, b - a), "shingles": pa.array(found, pa.list_(pa.int64()))})

    return df.mapInArrow(run, f"node {kind}, shingles array<long>")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, per_cent: int = 80) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` (smallest id reachable over links, its own included), ``kept``.

    Texts are linked when 100 * intersection >= ``per_cent`` * union of their sets of ``size``-word shingles. Texts of equal
    words are one node from the start. Nodes that share a band of the circulant signature are candidates; those too few of whose
    shingles occur in any other candidate are done. Every bucket compares its most central node with all of its members, and what is
    linked gets one label. From then on only members under another label than their bucket's most frequent one are
    carried: they are compared with the next 4 and 16 central nodes, and a member leaves as soon as it has its
    bucket's label. The last round compares what is left with every candidate under another label, as far as
    their rarest shingles meet, which those of a linked pair must. So every candidate pair is compared, already joined,
    or shown to be no link, and the many members of a large group aren't carried along for its few outer ones.

    Texts without words (null, empty, white space) are linked with nothing and stay. Rows with equal ids count as one
    document; a null id takes the component of equal texts, else null, and is kept only where that is null.
    An empty table gives no rows; other columns are not read.
    """
    rows, bands = bands_for(per_cent / 100)
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = stored(_signed(source, kind, size, rows, bands), "signatures")
    named = signed.where("digest is not null and id is not null")
    copies = stored(named.groupBy("digest").agg(F.min("id").alias("node")), "copies")

    first = named.join(copies.select("digest", F.col("node").alias("id")), ["digest", "id"])
    banded = stored(first.select(F.col("id").alias("node"), "n", F.explode("bands").alias("bucket")), "bands")
    shared = banded.groupBy("bucket").agg(F.count("*").alias("many")).where("many > 1")
    central = F.sum("many").over(Window.partitionBy("node")).alias("central")
    members = stored(banded.join(shared, "bucket").select("bucket", "node", "n", central), "members")
    involved = stored(members.select(F.col("node").alias("id")).distinct(), "involved")
    few = involved.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = source.join(F.broadcast(involved) if few else involved, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    sets = stored(_sets(texts, kind, size), "shingle-sets")
    nodes = stored(_shared(members.groupBy("node").agg(F.max("n").alias("n")), sets, per_cent), "nodes")
    rest = stored(members.join(nodes.select("node", "shared"), "node").withColumn("label", F.col("node")), "members")
    pool = stored(_central(rest, sum(CENTRES)), "centres")

    labels = links = tested = None
    used = 0
    for centres in (*CENTRES, None):
        if rest.isEmpty():
            break
        if centres is None:
            pairs = _prefix_pairs(nodes, rest.select("node").distinct(), labels, sets, per_cent)
        else:
            pairs = _pairs(rest, _labelled(pool.where(F.col("place").between(used + 1, used + centres)), labels), per_cent)
            used += centres
        pairs = stored(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = stored(_linked(pairs, sets, per_cent), "links")
        links = found if links is None else links.union(found)
        tested = pairs if tested is None else tested.union(pairs)
        labels = components(links)
        if centres is not None:
            rest = stored(_outside(_labelled(rest, labels), labels), "members")

    linked = copies if labels is None else copies.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("node"))
    out = signed.select("id", "n", "digest").join(linked.withColumnRenamed("node", "component"), "digest", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows of nodes with their nodes' present labels."""
    if labels is None:
        return rows
    return rows.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _central(members: DataFrame, many: int) -> DataFrame:
    """The most central members of each bucket, by ``place`` from 1."""
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("central"), "node"))
    return members.withColumn("place", place).where(F.col("place") <= many)


def _outside(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members under another label than ``main``, their bucket's: the most frequent one when first asked, and what it has become since."""
    if "main" in members.columns:
        moved = labels.select(F.col("node").alias("main"), F.col("label").alias("to"))
        return members.join(moved, "main", "left").withColumn("main", F.coalesce("to", "main")).drop("to").where("label <> main")
    sizes = members.groupBy("bucket", "label").agg(F.count("*").alias("size"))
    main = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").select(F.col("bucket").alias("of"), "main")
    return members.join(main, (F.col("bucket") == F.col("of")) & (F.col("label") != F.col("main"))).drop("of")


def _pairs(members: DataFrame, hubs: DataFrame, per_cent: int) -> DataFrame:
    """Distinct pairs of a centre and a member of its bucket under another label, as far as a link is possible.

    A link needs ``per_cent`` / (100 + ``per_cent``) of both sizes in common, and two sets have no more in common than
    the smaller set, and than what either has in common with any other set.
    """
    other = hubs.select(F.col("bucket").alias("of"), F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("label").alias("hub_label"), F.col("shared").alias("hub_shared"))
    fits = F.least("shared", "hub_shared") * (100 + per_cent) >= (F.col("n") + F.col("hub_n")) * per_cent
    met = members.join(other, (F.col("bucket") == F.col("of")) & (F.col("label") != F.col("hub_label")) & fits)
    return met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _prefix_pairs(nodes: DataFrame, hubs: DataFrame, labels: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Distinct pairs of a hub and a node under another label that can be linked, by their rarest shingles.

    With all shingles in one order, rarest first, two sets that have ``least`` shingles in common share one among the
    first n - least + 1 of each; ``least`` follows from both sizes. Shingles of one node alone take places but meet nothing.
    """
    each = sets.join(nodes, "node", "left_semi").select("node", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("many")).where("many > 1")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("many", "shingle"))
    ranked = each.join(often, "shingle").withColumn("rank", rank)
    # the shingles that nothing else holds come first and meet nothing; ``shared`` counts the others
    first = ranked.join(_labelled(nodes, labels), "node").withColumn("place", F.col("rank") + F.col("n") - F.col("shared"))
    first = stored(first.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * per_cent / 100) + 1).select("node", "n", "label", "shingle", "place"), "prefixes")
    other = first.join(hubs, "node", "left_semi").select(
        F.col("shingle").alias("met"), F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("label").alias("hub_label"), F.col("place").alias("hub_place")
    )
    least = F.ceil((F.col("n") + F.col("hub_n")) * per_cent / (100 + per_cent))
    near = (F.col("place") <= F.col("n") - least + 1) & (F.col("hub_place") <= F.col("hub_n") - least + 1)
    pairs = first.join(other, (F.col("shingle") == F.col("met")) & (F.col("label") != F.col("hub_label")) & near)
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _shared(nodes: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Nodes (node, n) with the number of their shingles that any other node has too; those with too few for any link are gone."""
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    lone = each.groupBy("shingle").agg(F.count("*").alias("many"), F.min("node").alias("node")).where("many = 1")
    found = nodes.join(lone.groupBy("node").agg(F.count("*").alias("lone")), "node", "left")
    found = found.select("node", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("shared"))
    return found.where(F.col("shared") * 100 >= F.col("n") * per_cent)


def _linked(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    met = pairs.join(a, "a").join(b, "b").select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).alias("sizes"))
    return met.where(F.col("common") * 100 >= (F.col("sizes") - F.col("common")) * per_cent).select("a", "b")
