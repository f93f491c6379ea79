"""Packing token sequences into windows by length combinations whose repeat counts solve a non-negative least squares problem."""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from centrum.llm.common import SLICE_BYTES, ChunkTable, held, slices, stored, sums_by_row, text_slices, words_at_spaces

#: Tokens that one packing group holds on average; groups are drawn by hash, so a frequent text or source can't fill one.
GROUP_TOKENS = 8_000_000


#: Words of ASCII and precomposed Latin letters: their normal form is their lower case, and their letters are known.
_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ž"
_PLAIN = re.compile(f"[!-~{_LATIN}]*")
#: The pre-tokeniser's pattern for such words.
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^{_LATIN}0-9]+")
#: What stands behind the letters of many words; runs of it are one part each.
_TAIL = "!#$%&*()+,-./:;<=>?@"
#: What each byte of a text is to ``parts``: 1 a letter, 2 a mark. ``|`` is none, as it ends special strings behind a letter.
_LETTER_OR_MARK = np.array([1 if chr(b).isalpha() and b < 128 else 2 if 32 < b < 127 and not chr(b).isalnum() and b != 124 else 0 for b in range(256)], np.uint8)
#: Special strings, and the first bytes of marks that join the letter before them: letters stay as they are beside these.
_KEEPS_CASE = (b"<|", b"\xcc", b"\xcd")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _mark_places(data: bytes) -> np.ndarray:
    """Where a mark follows an ASCII letter."""
    kind = _LETTER_OR_MARK[np.frombuffer(data, np.uint8)]
    return np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2)) + 1


def parts_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different parts of all texts, ended by spaces, line ends and marks behind an ASCII letter, in lower case; the
    place there of each part of the texts; and the number of parts of each text."""
    each = [t.encode() for t in texts]
    data = b" ".join(each).replace(b"\n", b" ")
    if not any(x in data for x in _KEEPS_CASE):
        data = data.lower()  # of bytes: ASCII alone
    letters = np.frombuffer(data, np.uint8)
    blank = letters == 32
    ends = blank.copy()
    ends[_mark_places(data)] = True
    ends = np.append(np.flatnonzero(ends), len(letters))
    at_blank = np.append(blank, False)[ends]
    offsets = np.insert(ends - np.cumsum(at_blank) + at_blank, 0, 0).astype(np.int32)
    found = pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(letters[~blank])).dictionary_encode()
    upto = np.searchsorted(ends, np.cumsum([len(x) + 1 for x in each]) - 1, "right")
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), np.diff(upto, prepend=0)


class _Words(ChunkTable):
    """Ids of the words between spaces. Plain words go straight to the library's merges, all others through all its steps."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.letters, self.merge = _byte_letters(), self.tokenizer.model.tokenize
        self.marks: dict[str, list[int]] = {}
        probe = ["It's", "naïve,", "x=12;", "ÉTÉ...", "odd$%&", "new!!***"]
        self.lines = all(self._library([f"{a}\n{b}"])[0] == sum(self._library([a, b]), []) for a in probe for b in probe)
        self.direct = [self._merged(w) for w in probe] == self._library(probe)  # only for tokenisers that work like this
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.apart = self.direct and self.lines and all(t.startswith(b"<|") and not len(_mark_places(t)) for t in special)
        super().__init__(self._encode)

    def _library(self, keys: list[str]) -> list[list[int]]:
        return [e.ids for a, b in slices(keys, 100_000) for e in self.tokenizer.encode_batch_fast(keys[a:b], add_special_tokens=False)]

    def words(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Words of all texts. A line's end is white space as a space is: apart, its neighbours are words seen before."""
        return words_at_spaces([t.replace("\n", " ") for t in texts] if self.lines else texts)

    def parts(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different words of all texts, in lower case and with the marks behind an ASCII letter apart; the place
        there of each word of the texts; and the number of words of each text.

        The pre-tokeniser ends a part at such a mark in any case, so ids stay, and fewer different words are left to encode.
        """
        if self.apart:
            return parts_of(texts)
        words, counts = self.words(texts)
        return words, np.arange(len(words)), counts

    def _part(self, part: str) -> list[int]:
        """Ids of a part that isn't letters alone; short ones are few and are kept."""
        ids = self.marks.get(part)
        if ids is None:
            ids = [t.id for t in self.merge(part)]
            if len(part) <= 3 and len(self.marks) < 10_000:
                self.marks[part] = ids
        return ids

    def _merged(self, word: str) -> list[int]:
        if word.isascii() and word.isalpha():  # most of what ``parts`` leaves is one part
            return [t.id for t in self.merge(word.lower())]
        word = word.lower()
        letters = word.rstrip(_TAIL)
        if letters.isalpha():  # what follows them is one part of the pattern
            tail = word[len(letters) :]
            ids = [t.id for t in self.merge(letters if word.isascii() else letters.encode().decode("latin-1").translate(self.letters))]
            return ids + self._part(tail) if tail else ids
        parts = _PARTS.findall(word)
        if not word.isascii():
            parts = [p.encode().decode("latin-1").translate(self.letters) for p in parts]
        return [i for p in parts for i in self._part(p)]

    def _encode(self, keys: list[str]) -> list[list[int]]:
        special = "<|" in "\n".join(keys)
        plain = [self.direct and (k.isascii() and k.isalpha() or _PLAIN.fullmatch(k) is not None and not (special and "<|" in k)) for k in keys]
        rest = iter(self._library([k for k, p in zip(keys, plain) if not p]))
        collecting = gc.isenabled()
        gc.disable()  # new lists hold numbers alone, which the collector would walk through again and again
        try:
            return [self._merged(k) if p else next(rest) for k, p in zip(keys, plain)]
        finally:
            if collecting:
                gc.enable()


def _table(path: str) -> _Words:
    return held(("words", path), lambda: _Words(path))


def word_ids(df: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (binary, little-endian unsigned 32-bit) and ``n`` of every whole text, ``end_id`` last.

    For tokenizers whose normaliser and pre-tokeniser drop white space and treat the words between spaces one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(tokenizer_path)
        for batch in batches:
            for a, texts in text_slices(batch.column(1)):
                b = a + len(texts)
                words, places, counts = table.parts(texts)
                at = table.find(words)[places]
                sizes = sums_by_row(table.lengths(at), counts)
                ids = np.insert(table.gather(at), np.cumsum(sizes), end_id).astype("<u2" if _short(table, end_id) else "<u4")
                width = ids.dtype.itemsize
                offsets = np.concatenate([[0], np.cumsum(sizes + 1) * width]).astype(np.int64)
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), data.cast(pa.binary()), pa.array(sizes + 1)], ["id", "ids", "n"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids binary, n long")


def _short(table: _Words, end_id: int) -> bool:
    return max(table.tokenizer.get_vocab_size(with_added_tokens=True), end_id) <= 1 << 16


def combinations(window: int) -> np.ndarray:
    """All sorted triples of lengths that fill the window exactly; 0 stands for no piece, so pairs are among them."""
    small = np.arange(window // 3 + 1)
    middle = [np.arange(max(a, 1), (window - a) // 2 + 1) for a in small]
    first = np.repeat(small, [len(m) for m in middle])
    second = np.concatenate(middle)
    return np.stack([first, second, window - first - second], axis=1)


def repeat_counts(histogram: np.ndarray, triples: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Non-negative counts x of the combinations that minimise the squared difference to the histogram of lengths.

    Accelerated projected gradient steps: two passes over the combinations a round, no matrix. Position 0 is ignored.
    """
    scale = max(float(histogram.max(initial=0)), 1.0)
    goal = histogram / scale
    step = 1.0 / (3 * np.bincount(triples.ravel(), minlength=len(goal))[1:].max(initial=1))
    x = np.zeros(len(triples))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        lack = np.bincount(triples.ravel(), np.repeat(y, 3), len(goal)) - goal
        lack[0] = 0
        new = np.maximum(y - step * lack[triples].sum(axis=1), 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (before - 1) / t * (new - x), new
    return x * scale


def fill(lengths: np.ndarray, window: int, triples: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows (item, start, length, sequence, offset) that place every item of 1 to window - 1 tokens.

    Counts are rounded along the list so that sums hold, and cut to what is there. What no combination takes is laid end
    to end and cut at the window; the last, shorter rest is cut at powers of two.
    """
    order = np.argsort(lengths, kind="stable")
    have = np.bincount(lengths, minlength=window)
    begin = np.cumsum(have) - have
    used = np.zeros(window, np.int64)
    whole = np.diff(np.floor(np.concatenate([[0.0], np.cumsum(counts)]) + 0.5)).astype(np.int64)
    out, sequence = [], 0
    for k in np.flatnonzero(whole):
        parts = [int(p) for p in triples[k] if p]
        n = min(whole[k], min((have[p] - used[p]) // parts.count(p) for p in parts))
        for _ in range(n):
            offset = 0
            for p in parts:
                out.append((order[begin[p] + used[p]], 0, p, sequence, offset))
                used[p] += 1
                offset += p
            sequence += 1
    rest = np.concatenate([order[begin[p] + used[p] : begin[p] + have[p]] for p in range(window - 1, 0, -1)]) if window > 1 else order[:0]
    room = [window] * (int(lengths[rest].sum()) // window)
    left = int(lengths[rest].sum()) % window
    room += [1 << b for b in range(window.bit_length(), -1, -1) if left >> b & 1]
    place = offset = 0
    for item in rest:
        start, length = 0, int(lengths[item])
        while start < length:
            n = min(length - start, room[place] - offset)
            out.append((item, start, n, sequence + place, offset))
            start, offset = start + n, offset + n
            if offset == room[place]:
                place, offset = place + 1, 0
    return np.array(out, np.int64).reshape(-1, 5)


def pack(encoded: DataFrame, window: int = 2048, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row for each piece: id, start, length, ``ids`` (binary, 32-bit little-endian), doc_tokens, sequence_id, offset.

    ``encoded`` holds id, ids (binary, 16 or 32 bits each) and n. A text of a window or more gives whole windows first;
    the histogram of the rests (one number for each length) is solved once with non-negative least squares over all
    pairs and triples of lengths that fill a window. Each hash group of rows takes its share of the solution, rounds it
    and packs its residuals greedily. Sequences are full, but for the last of a group, whose lengths are powers of two.
    Rows with equal ids are packed each for itself; an empty table gives no rows; texts without tokens give no piece.
    """
    encoded = stored(encoded, "packing-ids")
    found = encoded.groupBy((F.col("n") % window).alias("rest")).agg(F.count("*").alias("items"), F.sum("n").alias("tokens")).toArrow().to_pydict()
    histogram = np.zeros(window)
    for length, items in zip(found["rest"], found["items"]):
        histogram[length] = items if length else 0
    groups = max(1, round(sum(found["tokens"]) / group_tokens))
    triples = combinations(window)
    solved = repeat_counts(histogram, triples)
    triples, solved = triples[keep := solved > 0], solved[keep]
    total = histogram.sum()

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(pa.Table.from_batches(batches), int(key[0].as_py()), window, triples, solved / max(total, 1))

    kind = encoded.schema["id"].dataType.simpleString()
    dealt = encoded.withColumn("group", F.pmod(F.xxhash64("id", F.crc32("ids"), F.lit("packing")), F.lit(groups)).cast("int"))
    out = f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("group").applyInArrow(run, out)


def _packed(rows: pa.Table, group: int, window: int, triples: np.ndarray, share: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The pieces of a group, about ``SLICE_BYTES`` of ids at a time: ids are cut from the rows' own buffers when a batch is made."""
    held()  # drops the words that the worker kept while it made the ids
    n = rows.column("n").to_numpy()
    full, rest = n // window, n % window
    items = np.flatnonzero(rest)
    placed = fill(rest[items], window, triples, share * len(items))
    doc = np.concatenate([np.repeat(np.arange(len(n)), full), items[placed[:, 0]]])
    blocks = np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full)
    start = np.concatenate([blocks * window, (full * window)[items[placed[:, 0]]] + placed[:, 1]])
    length = np.concatenate([np.full(len(blocks), window), placed[:, 2]])
    sequence = np.concatenate([np.arange(len(blocks)), placed[:, 3] + len(blocks)]) + (group << 32)
    offset = np.concatenate([np.zeros(len(blocks), np.int64), placed[:, 4]])
    kept, chunks, begin, size = rows.column("id").combine_chunks(), *_places(rows.column("ids"))
    short = size == 2 * n
    step = max(1, SLICE_BYTES // (4 * window))
    for a in range(0, len(doc), step):
        of, first, count = doc[a : a + step], start[a : a + step], length[a : a + step]
        at, ends = begin[of] + first * np.where(short[of], 2, 4), np.cumsum(count)
        ids = np.empty(int(count.sum()), "<u4")
        for c, narrow, byte, m, end in zip(chunks[of].tolist(), short[of].tolist(), at.tolist(), count.tolist(), ends.tolist()):
            ids[end - m : end] = np.frombuffer(c, "<u2" if narrow else "<u4", m, byte)
        offsets = np.insert(4 * ends, 0, 0).astype(np.int32)
        data = pa.BinaryArray.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
        numbers = [pa.array(x.astype(np.int64)) for x in (first, count, n[of], sequence[a : a + step], offset[a : a + step])]
        columns = [kept.take(pa.array(of)), *numbers[:2], data, *numbers[2:]]
        yield pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def _places(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of a binary column: the buffer that holds it, its first byte there, and its number of bytes."""
    buffers, begins, sizes = [], [], []
    for chunk in column.chunks:
        width = np.dtype(np.int64 if pa.types.is_large_binary(chunk.type) else np.int32)
        ends = np.frombuffer(chunk.buffers()[1], width, len(chunk) + 1, width.itemsize * chunk.offset).astype(np.int64)
        held_in = np.empty(len(chunk), object)
        held_in.fill(chunk.buffers()[2])
        buffers.append(held_in), begins.append(ends[:-1]), sizes.append(np.diff(ends))
    return np.concatenate(buffers), np.concatenate(begins), np.concatenate(sizes)
