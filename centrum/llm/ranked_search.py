"""Ranked search, a term at a time, rarest terms first, with accumulators only for documents that can still win."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from centrum.llm.common import slices, stored

#: Bytes of items' terms that one pass searches for; more items make more passes.
PASS_BYTES = 16 << 20
#: Postings that a task holds inverted at once.
POSTINGS = 4_000_000
#: Fixed values of the ranking: weights are thousandths, B is the share of length in per cent.
SCALE, IMPACT, K, B = 1000, 1_000_000_000, 8, 90
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII digits and letters, A-Z in lower case, and of everything beyond ASCII."""
    return text.encode().translate(_LETTERS).split() if text else []


def weight(documents: int, holding: int) -> int:
    """The weight of a term that ``holding`` of all documents hold."""
    return math.floor(SCALE * math.log((2 * documents + 2) / (2 * holding + 1)))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each item's distinct terms. Rows of one id are one item; items without an id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = list(dict.fromkeys(terms_of(text.as_py())))
                yield pa.RecordBatch.from_pydict({"item": pa.array([item] * len(own), batch.schema.field(0).type), "term": pa.array(own, pa.binary())})

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"item {kind}, term binary").distinct()


def _counts(docs: DataFrame, terms: list[bytes], kind: str) -> DataFrame:
    """``id``, ``n`` (all terms of the whole text) and, for the wanted terms only, numbers and counts, of every document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(shared.value)}
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                words = [terms_of(t) for t in texts[a:b]]
                n = np.fromiter(map(len, words), np.int64, b - a)
                found = np.fromiter((place.get(w, -1) for own in words for w in own), np.int64, int(n.sum()))
                row = np.repeat(np.arange(b - a), n)[found >= 0]
                pairs, often = np.unique(row * len(place) + found[found >= 0], return_counts=True)
                sizes = np.bincount(pairs // max(len(place), 1), minlength=b - a)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                numbers = pa.ListArray.from_arrays(offsets, pa.array((pairs % max(len(place), 1)).astype(np.int32)))
                counts = pa.ListArray.from_arrays(offsets, pa.array(often.astype(np.int32)))
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), numbers, counts], ["id", "n", "terms", "counts"])
                yield out.filter(pa.array(n > 0))

    return docs.mapInArrow(run, f"id {kind}, n long, terms array<int>, counts array<int>")


class _Shard:
    """Some documents, inverted: for each term the places of its documents, in order, with what it adds to their scores."""

    def __init__(self, n: np.ndarray, terms: np.ndarray, owner: np.ndarray, often: np.ndarray, weights: np.ndarray, documents: int, length: int):
        self.size = len(n)
        slow = 100 - B + (B * n * documents) // length
        order = np.argsort(terms, kind="stable")
        terms, self.doc, often = terms[order], owner[order], often[order].astype(np.int64)
        self.adds = weights[terms] * ((IMPACT * often) // (SCALE * often + K * slow[self.doc]))
        self.ends = np.searchsorted(terms, np.arange(len(weights) + 1))
        most = np.zeros(len(weights), np.int64)
        some = np.flatnonzero(np.diff(self.ends))
        if len(some):
            most[some] = np.maximum.reduceat(self.adds, self.ends[some])
        self.most = most

    def search(self, query: np.ndarray, k: int, known: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and exact scores, with all of this shard's best ``k``, given that ``k`` documents elsewhere have ``known``.

        ``query`` lists terms, rarest first; ``sums`` is room for accumulators, all zero. While a document seen for the
        first time can still reach the ``k``-th best partial score, terms create accumulators. From then on they only
        add to those whose partial score and remaining bound still reach it, found by search in the term's postings.
        """
        left = np.cumsum(self.most[query][::-1])[::-1]
        limit, touched, at = known, [], 0
        for at, term in enumerate(query):
            a, b = self.ends[term], self.ends[term + 1]
            if left[at] < limit or left[at] == 0:
                break
            sums[self.doc[a:b]] += self.adds[a:b]
            touched.append(self.doc[a:b])
            if at + 1 < len(query):
                limit = max(known, _kth(sums, touched, k))
        else:
            at = len(query)
        made = np.unique(np.concatenate(touched)) if touched else np.empty(0, np.int64)
        score = sums[made]
        sums[made] = 0
        for i in range(at, len(query)):
            if len(score) > k:
                limit = max(limit, int(np.partition(score, len(score) - k)[len(score) - k]))
            stay = score + left[i] >= limit
            made, score = made[stay], score[stay]
            a, b = self.ends[query[i]], self.ends[query[i] + 1]
            if a < b and len(made):
                there = a + np.minimum(np.searchsorted(self.doc[a:b], made), b - a - 1)
                score = score + np.where(self.doc[there] == made, self.adds[there], 0)
        return made, score


def _kth(sums: np.ndarray, touched: list[np.ndarray], k: int) -> int:
    """A lower bound of the k-th best partial score: that among the documents of the rarest terms."""
    docs, have = [], 0
    for own in touched:
        docs.append(own)
        have += len(own)
        if have > 4096:
            break
    score = sums[np.unique(np.concatenate(docs))]
    return int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else 0


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``item_col``, ``rank`` (1 to ``k``), ``id_col``, ``score``: each item's highest-scoring documents, all with a score above 0.

    A document's score sums, over the item's distinct terms, weight * ((10^9 * tf) div (1000 * tf + 8 * m)) in whole
    numbers; see ``weight``; m grows with the document's share of the mean length. Equal scores go by ascending id,
    documents without an id come last among them.

    One pass counts the wanted terms of every whole text and stores them (nothing else of a text is needed again); document
    numbers, lengths and holders are sums over all of them. Then each task inverts its documents, some millions
    of postings at a time, searches all items in them, and keeps its best ``k`` an item, whose last score is the bound
    that its next documents have to reach. Tasks return at most ``k`` rows an item, merged by a window. Items are taken
    in passes of about ``PASS_BYTES``, the size of what the driver sees and broadcasts (a single item isn't split).

    Null texts hold no term and are found by none; rows with equal ids are documents of their own; rows of ``items`` with
    equal ids are one item, those with a null id or without a term give nothing; empty tables give no rows; other columns aren't read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_col].dataType.simpleString()
    wanted = stored(item_terms(items, item_col, item_text_col), "search-terms")
    size = wanted.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0
    passes = max(1, -(-size // PASS_BYTES))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = None
    for number in range(passes):
        part = wanted.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == number).toArrow()
        best = _best_of_pass(rows, part, k, kind, item_kind)
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _best_of_pass(rows: DataFrame, wanted: pa.Table, k: int, kind: str, item_kind: str) -> DataFrame:
    """At most ``k`` rows (item, id, score) a task and item of one pass."""
    terms = sorted(set(wanted.column("term").to_pylist()))
    place = {t: i for i, t in enumerate(terms)}
    counted = stored(_counts(rows, terms, kind), "search-counts")
    total = counted.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
    holding = np.zeros(len(terms), np.int64)
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toArrow()
    holding[held.column("term").to_numpy()] = held.column("n").to_numpy()
    weights = np.array([weight(total["documents"], h) for h in holding.tolist()], np.int64)
    queries: dict = {}
    for item, term in zip(wanted.column("item").to_pylist(), wanted.column("term").to_pylist()):
        if holding[place[term]]:
            queries.setdefault(item, []).append(place[term])
    queries = {i: np.array(sorted(own, key=lambda t: (holding[t], t)), np.int64) for i, own in queries.items()}
    shared = rows.sparkSession.sparkContext.broadcast((queries, weights, total["documents"], total["length"]))
    item_type = wanted.schema.field("item").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, documents, length = shared.value
        best: dict = {}
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + POSTINGS, "right")))
                part = batch.slice(first, last - first)
                owner = np.repeat(np.arange(last - first), sizes[first:last])
                numbers, counts = (part.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
                shard = _Shard(part.column(1).to_numpy(), numbers, owner, counts, weights, documents, length)
                ids = part.column(0).to_pylist()
                sums = np.zeros(shard.size, np.int64)
                for item, query in queries.items():
                    have = best.get(item, [])
                    made, score = shard.search(query, k, -have[-1][0] if len(have) == k else 1, sums)
                    if len(made):
                        if len(made) > k:  # ties of the k-th score stay until they are ordered by id
                            stay = score >= np.partition(score, len(score) - k)[len(score) - k]
                            made, score = made[stay], score[stay]
                        new = [(-s, ids[d] is None, ids[d]) for d, s in zip(made.tolist(), score.tolist()) if s > 0]
                        best[item] = sorted(have + new, key=lambda r: (r[0], r[1], r[2] if not r[1] else 0))[:k]
                first = last
        names = [i for i, own in best.items() for _ in own]
        flat = [r for own in best.values() for r in own]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, item_type), pa.array([r[2] for r in flat], counted_type), pa.array([-r[0] for r in flat], pa.int64())], ["item", "id", "score"]
        )

    counted_type = counted.limit(0).select("id").toArrow().schema.field("id").type
    return counted.mapInArrow(run, f"item {item_kind}, id {kind}, score long")
