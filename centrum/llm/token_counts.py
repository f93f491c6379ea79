"""Token counts: texts are encoded in batches inside Arrow functions, and only lengths come back."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from centrum.llm.common import ChunkTable, slices, sums_by_row, texts_of, words_at_spaces

#: Characters that every reading of the pre-tokeniser's pattern takes as not white space.
SOLID = "!-~¡-¬®-ɏ"
_SOLID_ENDS = re.compile(f"[{SOLID}](?:.*[{SOLID}])?", re.DOTALL)
_SAFE_SPACE = re.compile(f"(?<=[{SOLID}]) (?=[{SOLID}])")
#: Longer texts are cut, at safe spaces only, into parts of about so many characters.
PART = 1_000_000


def safe_parts(text: str, part: int = PART) -> list[str]:
    """The text cut at single spaces between two solid characters; parts after the first have lost their leading space.

    A byte-level pre-tokeniser starts a new chunk at such a space whatever stands around it, so counts add up.
    """
    parts, begin = [], 0
    while len(text) - begin > part and (cut := _SAFE_SPACE.search(text, begin + part)):
        parts.append(text[begin : cut.start()])
        begin = cut.end()
    return [*parts, text[begin:]]


class _Lengths(ChunkTable):
    """Token counts of chunks. A key after a space is a chunk as it is; any other key is a word, encoded after a space.

    Each chunk has two numbers: its count, and whether nothing can reach across its ends.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        super().__init__(self._encode)

    def _encode(self, keys: list[str]) -> list[list[int]]:
        out = []
        for a, b in slices(keys, 500_000):  # batches of about equal size
            chunks = [k[1:] if k[:1] == " " else f" {k}" for k in keys[a:b]]
            found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
            out += [[len(e), _SOLID_ENDS.fullmatch(k.removeprefix(" ")) is not None] for e, k in zip(found, keys[a:b])]
        return out

    def count(self, texts: list[str], after_space: list[bool]) -> np.ndarray:
        """Tokens of each text; those marked stand after a safe space that belongs to them."""
        words, counts = words_at_spaces(texts)
        starts = np.cumsum(counts) - counts
        for i, led in zip(starts, after_space):
            if not led:
                words[i] = f" {words[i]}"
        found = self.find(words)
        at = self.starts[found]
        out = sums_by_row(self.ids[at].astype(np.int64), counts)
        loose = sums_by_row((self.ids[at + 1] == 0).astype(np.int64), counts)
        for i in np.flatnonzero((loose > 0) & (counts > 1)):
            first, *rest = _SAFE_SPACE.split(texts[i])
            keys = [f"  {first}" if after_space[i] else f" {first}", *(f"  {c}" for c in rest)]
            found = self.find(keys)
            out[i] = int(self.ids[self.starts[found]].sum())
        return out


@lru_cache(maxsize=2)
def _table(path: str) -> _Lengths:
    return _Lengths(path)


def with_token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every whole text, without special tokens around it.

    Batches are cut by size, and long texts at spaces where no token can reach across, so a task holds a few MB at once;
    words that come again are counted from a table of distinct chunks. Null texts count as empty (0, 0); rows repeat as
    they do in the input; null ids stay; other columns are ignored whatever their names; an empty table gives no rows.
    The tokenizer file must exist at ``tokenizer_path`` on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(tokenizer_path)
        for batch in batches:
            parts = [(i, k > 0, p) for i, t in enumerate(texts_of(batch.column(1))) for k, p in enumerate(safe_parts(t))]
            rows, led, texts = ([p[k] for p in parts] for k in range(3))
            found = [table.count(texts[a:b], led[a:b]) for a, b in slices(texts)]
            totals = np.bincount(rows, np.concatenate(found), batch.num_rows) if rows else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(totals.astype(np.int64))], ["id", "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _bytes(F.col(text_col)).alias("n_bytes"))
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def _bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))
