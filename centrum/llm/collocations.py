"""Phrases and their collocation scores, counted in FM-indexes: one for each shard over word ids, extended on both sides, summed over shards."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from centrum.llm.common import slices, stored, texts_of

#: Words that one index holds; a longer piece between two separators isn't cut.
SHARD_WORDS = 1_000_000
LONGEST = 5
#: Up to so many phrases of one length (24 bytes each) are broadcast to find their places in the shards; more are joined.
BROADCAST_PHRASES = 1_000_000
#: Up to so many frequent words, of so many bytes, are broadcast to number the words of the shards; more are joined.
BROADCAST_WORDS, BROADCAST_BYTES = 300_000, 16 << 20
#: Pairs that a task holds and adds up before they are sent.
HELD_PAIRS = 1 << 20
#: White space inside a piece, and what ends a piece.
_BLANKS, _ENDS = b"\x09\x20", b".,;:!?\x0a\x0b\x0c\x0d"
_CHARS = bytes(10 if c in _ENDS else 32 if c in _BLANKS else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_and_ends(texts: list[str]) -> list[bytes]:
    """The words of all texts, A-Z in lower case, with ``.`` (never in a word) where a piece ends."""
    return "\n".join(texts).encode().translate(_CHARS).replace(b"\n", b" . ").split()


_SHARDS = pa.schema([("shard", pa.int64()), ("codes", pa.binary()), ("names", pa.list_(pa.struct([("lang", pa.string()), ("numbers", pa.binary()), ("words", pa.binary())])))])


def sequences(rows: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Rows of (lang, text) as shards, one row each: ``codes`` (32-bit numbers of words, 0 where a piece ends) and
    ``names``, the numbers and words of every language in one order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        names: dict[str, dict[bytes, int]] = {}
        held: list[np.ndarray] = []
        size = words_held = 0

        def out() -> Iterator[pa.RecordBatch]:
            codes = np.concatenate([*held, np.zeros(1, np.int32)])
            tables = []
            for lang, place in names.items():
                del place[b"."]
                numbers = np.fromiter(place.values(), np.int32, len(place))
                tables.append({"lang": lang, "numbers": packed(numbers.astype("<i4")), "words": packed(np.frombuffer(b"\n".join(place), np.uint8))})
            yield pa.RecordBatch.from_pylist([{"shard": number, "codes": packed(codes.astype("<i4")), "names": tables}], schema=_SHARDS)

        for batch in batches:
            langs = np.array([x if x is not None else "und" for x in batch.column(0).to_pylist()], object)
            texts = texts_of(batch.column(1))
            for a, b in slices(texts):
                for lang in dict.fromkeys(langs[a:b]):
                    words = words_and_ends([t for t, x in zip(texts[a:b], langs[a:b]) if x == lang])
                    place = names.setdefault(lang, {b".": 0})
                    for word in dict.fromkeys(words):
                        if word not in place:
                            words_held += 1
                            place[word] = words_held
                    held += [np.fromiter(map(place.__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32)]
                    size += len(words)
                if size >= shard_words:
                    yield from out()
                    number, names, held, size, words_held = number + 1, {}, [], 0, 0
        if words_held:
            yield from out()

    return rows.mapInArrow(run, "shard long, codes binary, names array<struct<lang:string,numbers:binary,words:binary>>")


def _names(row: dict) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """Language, numbers and words of each table of a shard's row."""
    for table in row["names"]:
        numbers = unpacked(table["numbers"])
        if len(numbers):
            yield table["lang"], numbers, unpacked(table["words"]).tobytes().split(b"\n")


def word_rows(shards: DataFrame) -> DataFrame:
    """One row for each word of each shard: (in_shard, code, lang, word, n), with its number and count there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                counts = np.bincount(unpacked(row["codes"]))
                for lang, numbers, words in _names(row):
                    for k in range(0, len(numbers), 20_000):
                        own = numbers[k : k + 20_000].astype(np.int32)
                        text = pa.array(words[k : k + 20_000], pa.binary()).cast(pa.string())
                        columns = [pa.array([row["shard"]] * len(own), pa.int64()), pa.array(own), pa.array([lang] * len(own), pa.string()), text]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(counts[own], pa.int64())], ["in_shard", "code", "lang", "word", "n"])

    return shards.mapInArrow(run, "in_shard long, code int, lang string, word string, n long")


def packed(values: np.ndarray) -> bytes:
    """The bytes of an array, compressed, after their number: shards are shuffled once for every length of phrases."""
    return len(values).to_bytes(8, "little") + values.dtype.itemsize.to_bytes(1, "little") + pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8]
    return np.frombuffer(pa.decompress(data[9:], n * width, codec="zstd", asbytes=True), f"<u{width}")


class Side:
    """One direction of an FM-index: the symbols before all suffixes in order, and where a suffix stands with its symbol in front."""

    def __init__(self, before: np.ndarray):
        self.before = before
        order = _stable_order(before)
        self.to = np.empty(len(before), np.int32)
        self.to[order] = np.arange(len(before), dtype=np.int32)
        self.first = before[order]

    def owners(self, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each place the interval that holds it, or -1. Intervals are disjoint."""
        out = np.full(len(self.before), -1, np.int32)
        out[_places(low, size)] = np.repeat(np.arange(len(low), dtype=np.int32), size)
        return out

    def extend(self, low: np.ndarray, other: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """All intervals one symbol longer on this side: parent, low here, low on the other side, size.

        Places with one parent and one symbol in front go to neighbouring places. On the other side a longer interval lies
        within its parent's, behind those of smaller symbols and of separators.
        """
        rows = _places(low, size)
        parent = np.repeat(np.arange(len(low), dtype=np.int32), size)
        some = self.before[rows] > 0
        ends = np.bincount(parent[~some], minlength=len(low))
        owner = np.full(len(self.before), -1, np.int32)
        owner[self.to[rows[some]]] = parent[some]
        at = np.flatnonzero(owner >= 0)
        if not len(at):
            return tuple(np.empty(0, np.int64) for _ in range(4))
        heads = np.flatnonzero(np.concatenate([[True], (owner[at[1:]] != owner[at[:-1]]) | (self.first[at[1:]] != self.first[at[:-1]])]))
        new_low, new_size, new_parent = at[heads], np.diff(np.append(heads, len(at))), owner[at[heads]]
        order = np.argsort(new_parent, kind="stable")  # symbols stay in order within a parent
        sizes, parents = new_size[order], new_parent[order]
        upto = np.cumsum(sizes) - sizes
        start = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        inside = upto - np.repeat(upto[start], np.diff(np.append(start, len(parents))))
        new_other = np.empty(len(order), np.int64)
        new_other[order] = other[parents] + ends[parents] + inside
        return new_parent, new_low, new_other, new_size


def _places(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(low - (ends - size), size)


def _stable_order(values: np.ndarray) -> np.ndarray:
    """Stable sort by radix: 16 bits a pass."""
    order = np.argsort(values.astype(np.uint16), kind="stable").astype(np.int32)
    if values.dtype.itemsize == 2:
        return order
    high = (values >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def symbols_before(codes: np.ndarray, depth: int = LONGEST) -> np.ndarray:
    """The Burrows-Wheeler transform, with suffixes ordered by their first ``depth`` symbols, as far as they are looked at."""
    padded = np.concatenate([codes, np.zeros(depth, codes.dtype)])
    order = np.arange(len(codes), dtype=np.int32)
    for k in range(depth - 1, -1, -1):
        order = order[_stable_order(padded[k : k + len(codes)][order])]
    return codes[order - 1]  # before the first symbol stands the last one, a separator


_INDEX = pa.schema([("shard", pa.int64()), ("forward", pa.binary()), ("backward", pa.binary()), ("ids", pa.list_(pa.int64()))])
INDEX = "shard long, forward binary, backward binary, ids array<long>"


def _index(shard: int, codes: np.ndarray, code: np.ndarray, ids: np.ndarray) -> list[list]:
    """The columns of a shard's index; the word numbered ``code`` has the id at the same place. Words are numbered anew, from 1."""
    kind = np.uint16 if len(code) < 1 << 16 else np.uint32
    new = np.zeros(max(int(codes.max()), int(code.max())) + 1, kind)
    new[code] = np.arange(1, len(code) + 1)
    codes = new[codes]
    codes = codes[(codes > 0) | np.concatenate([[True], codes[:-1] > 0])]  # one separator between pieces
    if codes[-1]:
        codes = np.append(codes, kind(0))
    both = [packed(symbols_before(c)) for c in (codes, np.roll(codes[::-1], -1))]
    return [[shard], [both[0]], [both[1]], [ids]]


def indexes(shards: DataFrame, words: DataFrame) -> DataFrame:
    """Both transforms of every shard over its frequent words alone; all other words end a piece, as no phrase holds them.

    ``words`` gives (lang, word, id). Counted to be few they are broadcast and a shard is indexed where it lies; more are
    joined to the words of the shards, which then meet their shard by its number. ``ids`` holds the words' ids.
    """
    few = words.limit(BROADCAST_WORDS + 1).toArrow()
    if few.num_rows <= BROADCAST_WORDS and few.nbytes <= BROADCAST_BYTES:
        places: dict[str, dict[bytes, int]] = {}
        for lang, word, i in zip(*(few.column(c).to_pylist() for c in ("lang", "word", "id"))):
            places.setdefault(lang, {})[word.encode()] = i
        shared = shards.sparkSession.sparkContext.broadcast(places)

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                    code, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                    for lang, numbers, names in _names(row):
                        known = shared.value.get(lang, {})
                        found = np.fromiter((known.get(w, -1) for w in names), np.int64, len(names))
                        code.append(numbers[found >= 0].astype(np.int64))
                        ids.append(found[found >= 0])
                    code = np.concatenate(code)
                    if len(code):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(v, t) for v, t in zip(_index(row["shard"], unpacked(row["codes"]), code, np.concatenate(ids)), _INDEX.types)], schema=_INDEX
                        )

        return shards.mapInArrow(local, INDEX)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _INDEX.empty_table()
        code = right.column("code").to_numpy().astype(np.int64)
        codes = unpacked(left.column("codes")[0].as_py())
        return pa.table(_index(left.column("shard")[0].as_py(), codes, code, right.column("id").to_numpy()), schema=_INDEX)

    numbers = word_rows(shards).join(words, ["lang", "word"]).select("in_shard", "code", "id")
    return shards.select("shard", "codes").groupBy("shard").cogroup(numbers.groupBy("in_shard")).applyInArrow(run, INDEX)


#: Intervals in one shard: the phrase's two parts (all but its last word, all but its first), its places, and its count there.
GRAMS = "shard long, prefix long, suffix long, low int, back_low int, size int"


def _sides(row: dict) -> list[Side]:
    return [Side(unpacked(row[c])) for c in ("forward", "backward")]


def longer(sides: list[Side], intervals: list[np.ndarray], ids: np.ndarray, turn: int) -> dict[str, np.ndarray]:
    """Phrases one word longer, to the left (``turn`` 0) or right (1), both of whose parts are among the given ones.

    The part that is extended is known. The other one is the given interval, in the same direction's order, that holds the new one.
    """
    here, there = intervals[turn], intervals[1 - turn]
    parent, low, other, size = sides[turn].extend(here, there, intervals[2])
    part = sides[turn].owners(here, intervals[2])[low]
    keep = part >= 0
    known, found = ids[parent[keep]], ids[part[keep]]
    lows = (low[keep], other[keep]) if turn == 0 else (other[keep], low[keep])
    prefix, suffix = (found, known) if turn == 0 else (known, found)
    return {"prefix": prefix, "suffix": suffix, "low": lows[0].astype(np.int32), "back_low": lows[1].astype(np.int32), "size": size[keep].astype(np.int32)}


class Numbers:
    """The ids of phrases by their two parts."""

    def __init__(self, prefix: np.ndarray, suffix: np.ndarray, ids: np.ndarray):
        self.prefixes, first = np.unique(prefix, return_inverse=True)
        self.suffixes, second = np.unique(suffix, return_inverse=True)
        keys = first.astype(np.int64) * max(len(self.suffixes), 1) + second
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]

    def find(self, prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """The id of each pair, or -1."""
        out = np.full(len(prefix), -1, np.int64)
        rows = np.arange(len(prefix) if len(self.ids) else 0)
        places = []
        for known, wanted in ((self.prefixes, prefix), (self.suffixes, suffix)):
            at = np.minimum(np.searchsorted(known, wanted[rows]), max(len(known) - 1, 0))
            stay = known[at] == wanted[rows]
            rows, places = rows[stay], [p[stay] for p in places] + [at[stay]]
        keys = places[0] * len(self.suffixes) + places[1]
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        same = self.keys[at] == keys
        out[rows[same]] = self.ids[at[same]]
        return out

    def keep(self, found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The places of known phrases, with their ids in place of their parts."""
        ids = self.find(found["prefix"], found["suffix"])
        return {c: found[c][ids >= 0] for c in found if c not in ("prefix", "suffix")} | {"id": ids[ids >= 0]}


#: Places of frequent phrases in one shard, as packed arrays; a shard may have several such rows.
LIVE = "shard long, low binary, back_low binary, size binary, id binary"


def _by_shard(found: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Places as one packed row for each shard among them."""
    order = np.argsort(found["shard"], kind="stable")
    shards, first = np.unique(found["shard"][order], return_index=True)
    rows = {"shard": pa.array(shards, pa.int64())}
    for c in ("low", "back_low", "size", "id"):
        rows[c] = pa.array([packed(part) for part in np.split(found[c][order], first[1:])] if len(shards) else [], pa.binary())
    return pa.RecordBatch.from_pydict(rows)


def _numbers(level: DataFrame):
    """A broadcast of the phrases' ids, if they are few enough."""
    ids = level.select("prefix", "suffix", "id")
    if ids.limit(BROADCAST_PHRASES + 1).count() > BROADCAST_PHRASES:
        return None
    table = ids.toArrow()
    return level.sparkSession.sparkContext.broadcast(Numbers(*(table.column(c).to_numpy() for c in ("prefix", "suffix", "id"))))


def _live(grams: DataFrame, level: DataFrame) -> DataFrame:
    """The places in all shards of the phrases that are frequent."""
    shared = _numbers(level)
    if shared is None:
        grams = grams.join(level.select("prefix", "suffix", "id"), ["prefix", "suffix"]).select("shard", "low", "back_low", "size", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            yield _by_shard(found if shared is None else shared.value.keep(found))

    return grams.mapInArrow(run, LIVE)


def _found(batches: Iterator[pa.RecordBatch], known: list) -> Iterator[dict[str, np.ndarray]]:
    """Phrases of each shard, grown in its index from one word on: ``known`` holds a broadcast of the frequent phrases of
    2, 3, ... words, and what comes out is one word longer than the last of them."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in ("shard", "forward", "backward")}
            sides, ids = _sides(row), batch.column("ids")[i].values.to_numpy()
            words = np.arange(1, len(ids) + 1, dtype=sides[0].first.dtype)
            low = np.searchsorted(sides[0].first, words)
            size = np.searchsorted(sides[0].first, words, "right") - low
            found = longer(sides, [low, low, size], ids, 1)
            for k, level in enumerate(known):
                live = level.value.keep(found)
                found = longer(sides, [live[c].astype(np.int64) for c in ("low", "back_low", "size")], live["id"], k % 2)
            yield {"shard": np.full(len(found["size"]), row["shard"])} | found


def _grown(index: DataFrame, known: list) -> DataFrame:
    """What ``_found`` gives, as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _found(batches, known):
            for k in range(0, len(found["size"]), 100_000):
                yield pa.RecordBatch.from_pydict({c: v[k : k + 100_000] for c, v in found.items()})

    return index.mapInArrow(run, GRAMS)


def _summed(prefix: np.ndarray, suffix: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each pair once, in order, with the sum of its sizes."""
    order = np.lexsort((suffix, prefix))
    prefix, suffix = prefix[order], suffix[order]
    heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), (prefix[1:] != prefix[:-1]) | (suffix[1:] != suffix[:-1])]))
    return prefix[heads], suffix[heads], np.add.reduceat(size[order], heads, dtype=np.int64) if len(heads) else np.zeros(0, np.int64)


def _pairs_packed(prefix: np.ndarray, suffix: np.ndarray, size: np.ndarray) -> bytes:
    """Ordered pairs and their sizes, byte by byte, as neighbours differ in the low ones."""
    values = np.stack([np.diff(prefix, prepend=0), suffix, size]).astype("<i8")
    return packed(values.view(np.uint8).reshape(3, -1, 8).swapaxes(1, 2).ravel())


def _pairs_unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    values = np.ascontiguousarray(unpacked(data).reshape(3, 8, -1).swapaxes(1, 2)).view("<i8")[..., 0]
    return np.cumsum(values[0]), values[1], values[2]


def _group_of(prefix: np.ndarray, suffix: np.ndarray, groups: int) -> np.ndarray:
    mixed = prefix.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + suffix.astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed >> np.uint64(32)) % np.uint64(groups)).astype(np.uint16 if groups <= 1 << 16 else np.int64)


def _counts(rows: DataFrame, found, groups: int, least: int) -> DataFrame:
    """(prefix, suffix, f): the pairs that ``found`` gives for the batches of ``rows``, with their sums of at least ``least``.

    A task adds up what it finds and sends it by hash of the pair, packed as one row for each group: a few bytes a pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(v) for v in zip(*held)]
            held.clear()
            pairs = _summed(*columns)
            del columns
            group = _group_of(pairs[0], pairs[1], groups)
            order = np.argsort(group, kind="stable")
            numbers, first = np.unique(group[order], return_index=True)
            data = [_pairs_packed(*(v[at] for v in pairs)) for at in np.split(order, first[1:])] if len(numbers) else []
            yield pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int64)), pa.array(data, pa.binary())], ["group", "pairs"])

        for one in found(batches):
            held.append([one[c] for c in ("prefix", "suffix", "size")])
            size += len(one["size"])
            if size >= HELD_PAIRS:
                yield from out()
                size = 0
        if size:
            yield from out()

    def merge(table: pa.Table) -> pa.Table:
        pairs = _summed(*(np.concatenate(v) for v in zip(*(_pairs_unpacked(x.as_py()) for x in table.column("pairs")))))
        keep = pairs[2] >= least
        return pa.table([pa.array(v[keep]) for v in pairs], ["prefix", "suffix", "f"])

    return rows.mapInArrow(run, "group long, pairs binary").groupBy("group").applyInArrow(merge, "prefix long, suffix long, f long")


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    for batch in batches:
        yield {c: batch.column(c).to_numpy() for c in batch.schema.names}


def _longer(index: DataFrame, live: DataFrame, turn: int) -> DataFrame:
    """Phrases one word longer than those of ``live``, of all shards."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shape = pa.schema([("shard", pa.int64()), ("prefix", pa.int64()), ("suffix", pa.int64()), *((c, pa.int32()) for c in ("low", "back_low", "size"))])
        if not left.num_rows or not right.num_rows:
            return shape.empty_table()
        row = left.to_pylist()[0]
        *intervals, ids = (np.concatenate([unpacked(v.as_py()).astype(np.int64) for v in right.column(c)]) for c in ("low", "back_low", "size", "id"))
        found = longer(_sides(row), intervals, ids, turn)
        return pa.table({"shard": np.full(len(found["size"]), row["shard"])} | found, schema=shape)

    return index.select("shard", "forward", "backward").groupBy("shard").cogroup(live.groupBy("shard")).applyInArrow(run, GRAMS)


def phrases(df: DataFrame, least: int = 100, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Phrases of 2 to ``longest`` (at most 5) words that occur ``least`` times or more in their language.

    Returns ``lang``, ``phrase`` (joined by spaces), ``words`` (their number), ``a`` (its count), ``n`` (all words of the language), ``l``, ``r``
    and ``score`` = floor(1000 * a * n / (l * r)) of its lowest-scoring cut into two (the first of equal ones),
    ``cut`` (words before it), ``best_left`` and ``best_right`` (counts of the most frequent phrase one word longer on
    that side; 0 if none is a candidate). A phrase lies in a longer one of the same count exactly if ``best_left`` or ``best_right`` is ``a``.

    Tasks turn their rows into shards of word numbers. Words are counted over all shards, and each shard gets an FM-index of its
    frequent words in both directions. Intervals of phrases grow by a word, to the right and to the left in turn, if both parts
    are frequent in the whole corpus; counts are summed over shards before the next step, so nothing is missed: a
    phrase is at most as frequent as its parts. Sizes of all tables follow the corpus; only tables counted to be small are broadcast.

    Null texts are empty, a null language is ``und``; repeated rows count each; other columns aren't read; an empty table
    gives no rows. A text without separators is one piece, however long it is.
    """
    shards = stored(sequences(df.select(F.col(lang_col).cast("string"), F.col(text_col)), shard_words), "phrase-shards")
    words = stored(word_rows(shards).groupBy("lang", "word").agg(F.sum("n").alias("f")), "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    none = F.array().cast("array<long>")
    level = stored(words.where(F.col("f") >= least).select(F.monotonically_increasing_id().alias("id"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("heads"), none.alias("tails")), "phrase-level")
    index = stored(indexes(shards, level.select("lang", F.col("phrase").alias("word"), "id")), "phrase-index")

    # as long as the frequent phrases can be broadcast, an index is read again for each length, where it lies, and shorter
    # phrases are found anew; beyond that their places are stored and meet the indexes by shard
    groups = max(1, shards.count())
    grams, levels, known = None, {}, []
    for size in range(2, longest + 1):
        if grams is None:
            counts = _counts(index, partial(_found, known=list(known)), groups, least)
        else:
            counts = _counts(grams.select("prefix", "suffix", "size"), _columns, groups, least)
        level = levels[size] = _next_level(counts, level)
        if size < longest:
            shared = _numbers(level) if grams is None else None
            if shared is None:
                grams = stored(_longer(index, _live(_grown(index, known) if grams is None else grams, level), size % 2), "phrase-grams")
            else:
                known.append(shared)
    out = None
    for size, level in levels.items():
        found = level.select("lang", "phrase", F.lit(size).alias("words"), F.col("f").alias("a"), "id", "heads", "tails")
        if size < longest:
            best = [levels[size + 1].groupBy(F.col(c).alias("id")).agg(F.max("f").alias(n)) for c, n in (("suffix", "best_left"), ("prefix", "best_right"))]
            found = found.join(best[0], "id", "left").join(best[1], "id", "left").na.fill(0, ["best_left", "best_right"])
        else:
            found = found.withColumn("best_left", F.lit(0).cast("long")).withColumn("best_right", F.lit(0).cast("long"))
        out = found if out is None else out.unionByName(found)
    scored = out.join(totals, "lang").withColumn("best", _lowest_cut())
    return scored.select("lang", "phrase", "words", "a", "n", "best.l", "best.r", "best.score", F.col("best.k").alias("cut"), "best_left", "best_right")


def _next_level(summed: DataFrame, level: DataFrame) -> DataFrame:
    """The phrases whose counts over all shards suffice, with the counts of everything they begin and end with."""
    head = level.select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("begin"), F.concat("heads", F.array("f")).alias("heads"))
    tail = level.select(F.col("id").alias("suffix"), "last", F.concat("tails", F.array("f")).alias("tails"))
    joined = summed.join(head, "prefix").join(tail, "suffix")
    phrase = F.concat_ws(" ", "begin", "last").alias("phrase")
    return stored(joined.select(F.monotonically_increasing_id().alias("id"), "prefix", "suffix", "lang", phrase, "last", "f", "heads", "tails"), "phrase-level")


def _lowest_cut() -> Column:
    """The cut with the lowest score, in whole numbers of up to 38 digits."""
    number = lambda c: c.cast("decimal(18,0)")

    def cut(k: Column) -> Column:
        l, r = F.element_at("heads", k), F.element_at("tails", F.col("words") - k)
        thousands = (number(F.col("a")) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(20,0)")
        score = F.call_function("div", thousands * number(F.col("n")), number(l) * number(r))
        return F.struct(score.cast("long").alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.col("words") - 1), cut))
