"""Shared helpers: stored intermediate tables, Arrow columns in and out, and tables of distinct chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from centrum.session import scratch_path

#: Bytes of text that a task works on at once; an Arrow batch may be larger.
SLICE_BYTES = 1_000_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: a lost executor costs a read, not the work before."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(column: pa.Array) -> list[str]:
    """The strings of a column, null as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """The strings of a column, null as empty, in runs of about ``limit`` bytes, each with its first row; only one run is
    taken out of the column at a time, a longer text alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    before, first = np.insert(np.cumsum(sizes), 0, 0), 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(before, before[first] + limit, "right")) - 1)
        yield first, texts_of(column.slice(first, last - first))
        first = last


def slices(texts: list[str], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring rows with about ``limit`` characters each; a longer text stands alone."""
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def sums_by_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each row's consecutive values; rows may have none."""
    running = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    ends = np.cumsum(counts)
    return running[ends] - running[ends - counts]


#: What the step that a Python worker serves keeps from task to task.
_held: dict = {}


def held(key=None, make: Callable | None = None):
    """A worker's table, made once. Spark gives a worker to one step after the other: what an earlier one kept is dropped first."""
    if key not in _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        if make is None:
            return None
        _held[key] = make()
    return _held[key]


class ChunkTable:
    """Distinct chunks of text, each encoded once, with their ids in one flat array.

    ``encode`` maps a list of chunks to a list of id lists. The table lives as long as a Python worker. When it holds
    ``limit`` chunks or ``characters`` characters, the half that was asked for most often stays, so that memory is bounded
    and frequent chunks aren't encoded again; results never depend on that.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = 200_000, characters: int = 16_000_000):
        self.encode, self.limit, self.characters = encode, limit, characters
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.held = 0
        self.ids = np.empty(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.asked = np.zeros(0, np.int64)

    def find(self, chunks: list[str]) -> np.ndarray:
        """The place of every chunk; unknown ones are encoded first."""
        if len(self.place) > self.limit or self.held > self.characters:
            self._shrink()
        at = np.fromiter(map(self.place.get, chunks, repeat(-1)), np.int64, len(chunks))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            wanted = [chunks[i] for i in unknown.tolist()]
            self._add(list(dict.fromkeys(wanted)))
            at[unknown] = np.fromiter(map(self.place.__getitem__, wanted), np.int64, len(wanted))
        asked = np.bincount(at, minlength=len(self.place))
        asked[: len(self.asked)] += self.asked
        self.asked = asked
        return at

    def _shrink(self) -> None:
        """Keep the chunks asked for most often: at most half of the table and half of the characters."""
        names = list(self.place)
        sizes = np.fromiter(map(len, names), np.int64, len(names))
        order = np.argsort(-self.asked, kind="stable")[: self.limit // 2]
        kept = np.sort(order[np.cumsum(sizes[order]) <= self.characters // 2])
        asked = self.asked[kept] // 2
        if not len(kept):
            self.clear()
            return
        self.retain(kept)
        self.place = {names[i]: k for k, i in enumerate(kept.tolist())}
        self.held, self.asked = int(sizes[kept].sum()), asked

    def retain(self, places: np.ndarray) -> None:
        """Only these places, in this order."""
        lengths, ids = self.lengths(places), self.gather(places)
        self.starts = np.concatenate([[0], np.cumsum(lengths), np.zeros(1 << 14, np.int64)]).astype(np.int64)
        self.ids = np.concatenate([ids, np.empty(1 << 16, np.int32)])

    def _add(self, chunks: list[str]) -> None:
        found = self.encode(chunks)
        self.held += sum(map(len, chunks))
        have = len(self.place)
        self.place.update(zip(chunks, range(have, have + len(chunks))))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ends = self.starts[have] + np.cumsum(lengths)
        if have + len(chunks) + 1 > len(self.starts):
            self.starts = np.resize(self.starts, 2 * (have + len(chunks) + 1))
        self.starts[have + 1 : have + 1 + len(chunks)] = ends
        if ends[-1] > len(self.ids):
            self.ids = np.resize(self.ids, 2 * int(ends[-1]))
        self.ids[ends[0] - lengths[0] : ends[-1]] = np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum()))

    def lengths(self, at: np.ndarray) -> np.ndarray:
        return self.starts[at + 1] - self.starts[at]

    def gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of the chunks at these places, one after the other."""
        lengths = self.lengths(at)
        before = np.cumsum(lengths) - lengths
        return self.ids[np.repeat(self.starts[at] - before, lengths) + np.arange(int(lengths.sum()))]


def words_at_spaces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """What stands between single spaces, over all texts, and the number of these words of each text (one at least)."""
    counts = np.fromiter((t.count(" ") + 1 for t in texts), np.int64, len(texts))
    return (" ".join(texts).split(" ") if texts else []), counts
