"""Subword pieces: every distinct marked word is encoded once, and ids are joined back by position."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from centrum.llm.common import ChunkTable, slices, sums_by_row, texts_of, words_at_spaces

MARK = "▁"
_MARKED = re.compile(f"{MARK}+[^{MARK}]*")


class _Pieces(ChunkTable):
    """Ids of marked words. The key is the library's input for the word; a lone mark at the end of a text is the mark itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        crossing = [p for i in range(self.model.get_piece_size()) if MARK in (p := self.model.id_to_piece(i)).lstrip(MARK)]
        if crossing or self.model.encode("a  b ", out_type=str, emit_unk_piece=True)[:1] != [f"{MARK}a"]:
            raise ValueError(f"pieces of {path} cross white space, so words can't be encoded on their own")
        super().__init__(self._encode)

    def clear(self) -> None:
        super().clear()
        self.decoded: list[str] = []

    def retain(self, places: np.ndarray) -> None:
        super().retain(places)
        self.decoded = [self.decoded[i] for i in places.tolist()]

    def _encode(self, keys: list[str]) -> list[list[int]]:
        ids = self.model.encode([k if k != MARK else "" for k in keys], num_threads=1)
        for i, k in enumerate(keys):
            if k in ("", MARK):
                ids[i] = [self.model.piece_to_id(MARK)] if k == MARK else []
        # one mark comes off the front of what is decoded; the text puts it back as the space between words
        self.decoded += [d if i else "" for i, d in zip(ids, self.model.decode(ids))] if ids else []
        return ids

    def words(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The keys of all texts in order, and their number for each text."""
        if not any("  " in t or MARK in t or t[:1] in ("", " ") or t[-1] == " " for t in texts):
            return words_at_spaces(texts)
        keys, counts = [], []
        for text in texts:
            if "  " in text or MARK in text or text[:1] in ("", " ") or text[-1] == " ":
                own = [_key(c) for c in _MARKED.findall(MARK + text.replace(" ", MARK))] if text else []
            else:
                own = text.split(" ")
            keys += own
            counts.append(len(own))
        return keys, np.array(counts, np.int64)


def _key(chunk: str) -> str:
    word = chunk.lstrip(MARK)
    marks = len(chunk) - len(word)
    return " " * (marks - 1) + word if word or marks > 1 else MARK


@lru_cache(maxsize=2)
def _table(path: str) -> _Pieces:
    return _Pieces(path)


def _encoded(table: _Pieces, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    keys, counts = table.words(texts)
    at = table.find(keys)
    sizes = sums_by_row(table.lengths(at), counts)
    words = [table.decoded[i] for i in at.tolist()]
    ends = np.cumsum(counts)
    return table.gather(at), sizes, [" ".join(words[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist())]


def encode_and_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (array of int, exactly the library's) and ``decoded`` (what the library makes of these ids).

    A text is cut before every run of white space marks. No piece of the model holds a mark behind another character
    (this is checked), so merges never reach over a cut: each distinct marked word is encoded and decoded once in a
    task's table, and texts are put together again from the table by position. No begin or end ids, no sampling.
    Null texts count as empty (no ids, empty text); runs of spaces, leading and trailing spaces keep their marks; rows
    repeat as in the input; other columns are ignored; an empty table gives no rows. ``model_path`` must exist on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model_path)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in slices(texts):
                ids, sizes, decoded = _encoded(table, texts[a:b])
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), rows, pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").select(F.col("id").alias(id_col), "ids", "decoded")
