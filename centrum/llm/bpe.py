"""Byte-pair encoding by speculation: greedy longest matches propose tokens, checks of neighbours verify them, and only words that fail are merged step by step."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from centrum.llm.common import ChunkTable, sums_by_row, text_slices, words_at_spaces
from centrum.llm.packing import _PARTS, _PLAIN, _byte_letters, _mark_places, parts_of

#: Stands for the end of a word; byte-level letters are never spaces.
END = " "
_NEVER = np.int64(1) << 60


class Merges:
    """The merges of a vocabulary whose words end in a suffix: how each token is built, and which neighbours stay apart."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.suffix, self.size = suffix, max(vocab.values()) + 1
        self.letters = {t: i for t, i in vocab.items() if len(t.removesuffix(suffix) or t) == 1}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right = (np.fromiter((vocab[p[k]] for p in pairs), np.int64, len(pairs)) for k in (0, 1))
        made = np.fromiter((vocab[a + b] for a, b in pairs), np.int64, len(pairs))
        order = np.argsort(left * self.size + right, kind="stable")
        self.keys, self.ranks, self.made = (left * self.size + right)[order], order, made[order]
        #: The merge that builds a token, its two parts, and that merge's rank; -1 for letters.
        self.rank, self.left, self.right = (np.full(self.size, -1, np.int64) for _ in range(3))
        self.rank[made[::-1]] = np.arange(len(pairs))[::-1]
        self.left[made[::-1]], self.right[made[::-1]] = left[::-1], right[::-1]
        twice = np.bincount(made, minlength=self.size) > 1
        ordered = (self.rank[left] < np.arange(len(pairs))) & (self.rank[right] < np.arange(len(pairs)))
        if not ordered.all():
            raise ValueError("merges must come after those of their parts")
        whole = self.apart(left, right, below=True)
        #: Tokens that merging gives for their own letters; others are never proposed.
        self.proper = ~twice
        for t, a, b, fine in zip(made.tolist(), left.tolist(), right.tolist(), whole.tolist()):
            self.proper[t] &= fine and self.proper[a] and self.proper[b]
        self.automaton = ahocorasick.Automaton()
        self.text_size = np.zeros(self.size, np.int64)
        for t, i in vocab.items():
            if self.proper[i]:
                shown = t[: -len(suffix)] + END if t.endswith(suffix) and t != suffix else t
                self.text_size[i] = len(shown)
                self.automaton.add_word(shown, i)
        self.automaton.make_automaton()

    def merge_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the merge of each pair; a rank beyond all where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        return np.where(known, self.ranks[at], _NEVER), np.where(known, self.made[at], -1)

    def apart(self, a: np.ndarray, b: np.ndarray, below: bool = False) -> np.ndarray:
        """Whether no merge ever joins the last part of ``a`` to the first part of ``b`` while the two are built.

        Both are taken apart again, latest merge first. Whatever stands on the two sides of the border at one time must
        not have a merge that comes before the next merge on either side; equal merges go from left to right.
        With ``below`` the finished tokens themselves may merge.
        """
        fine = np.ones(len(a), bool)
        row = np.arange(len(a))
        x, y = a.copy(), b.copy()
        next_x, next_y = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        first = below
        while len(row):
            if not first:
                joins = self.merge_of(x, y)[0]
                bad = (joins < next_x) & (joins <= next_y) & (joins < _NEVER)
                fine[row[bad]] = False
                go = ~bad & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            else:
                go = (self.rank[x] >= 0) | (self.rank[y] >= 0)
            first = False
            row, x, y, next_x, next_y = row[go], x[go], y[go], next_x[go], next_y[go]
            of_x = self.rank[x] > self.rank[y]
            next_x = np.where(of_x, self.rank[x], next_x)
            next_y = np.where(of_x, next_y, self.rank[y])
            x, y = np.where(of_x, self.right[x], x), np.where(of_x, y, self.left[y])
        return fine

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all parts, one after the other, and the number of each part's tokens. Parts aren't empty."""
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        text = END.join([*parts, ""])
        found = np.fromiter(chain.from_iterable(self.automaton.iter_long(text)), np.int64).reshape(-1, 2)
        ends, ids = found[:, 0] + 1, found[:, 1]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        part = np.repeat(np.arange(len(parts)), sizes)[ends - 1]  # the part that a token ends in
        covered = np.bincount(part, self.text_size[ids], len(parts)) == sizes
        inside = np.flatnonzero(part[1:] == part[:-1])
        pairs, at = np.unique(ids[inside] * self.size + ids[inside + 1], return_inverse=True)
        bad = ~self.apart(pairs // self.size, pairs % self.size)[at]
        wrong = ~covered
        wrong[part[inside[bad]]] = True
        counts = np.bincount(part, minlength=len(parts))
        if not wrong.any():
            return ids, counts
        redo = np.flatnonzero(wrong)
        merged, merged_counts = self.merge([parts[i] for i in redo])
        counts[redo] = merged_counts
        ends_out = np.cumsum(counts)
        out = np.empty(int(ends_out[-1]), np.int64)
        slow = np.repeat(wrong, counts)
        out[~slow], out[slow] = ids[~wrong[part]], merged
        return out, counts

    def merge(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by merging: in every round each part applies its first merge, at all places from left to right."""
        names = [c for p in parts for c in (*p[:-1], p[-1] + self.suffix)]
        ids = np.fromiter(map(self.letters.__getitem__, names), np.int64, len(names))
        part = np.repeat(np.arange(len(parts)), np.fromiter(map(len, parts), np.int64, len(parts)))
        done_ids, done_part = [], []
        while len(ids) > 1:
            rank, made = self.merge_of(ids[:-1], ids[1:])
            rank[part[:-1] != part[1:]] = _NEVER
            heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            lowest = np.minimum.reduceat(np.append(rank, _NEVER), heads)
            spans = np.diff(np.append(heads, len(ids)))
            live = np.repeat(lowest < _NEVER, spans)
            hit = (rank == np.repeat(lowest, spans)[:-1]) & (rank < _NEVER)
            # of overlapping places, as in "aaa", every second one from the left
            places = np.flatnonzero(hit)
            if not len(places):
                break
            runs = np.cumsum(np.concatenate([[True], np.diff(places) > 1])) - 1
            starts = places[np.unique(runs, return_index=True)[1]]
            places = places[(places - starts[runs]) % 2 == 0]
            ids[places] = made[places]
            keep = np.ones(len(ids), bool)
            keep[places + 1] = False
            done_ids.append(ids[~live])
            done_part.append(part[~live])
            ids, part = ids[keep & live], part[keep & live]
        done_ids.append(ids)
        done_part.append(part)
        all_part = np.concatenate(done_part)
        order = np.argsort(all_part, kind="stable")
        return np.concatenate(done_ids)[order], np.bincount(all_part, minlength=len(parts))


class _Words(ChunkTable):
    """Ids of the parts of words; decoded texts are made of the names of their ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            kept = json.load(file)
        model, suffix = kept["model"], kept["model"].get("end_of_word_suffix")
        plain = model["type"] == "BPE" and suffix and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if not plain or kept["decoder"] is not None:
            raise ValueError(f"{path} is no byte-pair vocabulary with word ends and without a decoder")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.merges = Merges(model["vocab"], model["merges"], suffix)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        self.names = pa.array(map(self.tokenizer.id_to_token, range(max([self.merges.size - 1, *added]) + 1)), pa.large_string())
        self.bytes = _byte_letters()
        probe = ["It's", "naïve,", "x=12;", "ÉTÉ..."]
        self.direct = [self._plain_parts(w) for w in probe] == [self._library_parts(w) for w in probe]
        lines = all(self._library_parts(f"{a}\n{b}") == self._library_parts(a) + self._library_parts(b) for a in probe for b in probe)
        self.apart = self.direct and lines and all(t.startswith("<|") and "\n" not in t and not len(_mark_places(t.encode())) for t in self.added)
        super().__init__(self._encode)

    def words(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """What is encoded once, the place there of each word of the texts, and the number of words of each text: parts
        of words where the pre-tokeniser ends one at every mark behind a letter, else what stands between spaces."""
        if self.apart:
            return parts_of(texts)
        words, counts = words_at_spaces(texts)
        return words, np.arange(len(words)), counts

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The names of each text's ids, with a space between them, as without a decoder."""
        offsets = pa.array(np.insert(np.cumsum(sizes), 0, 0), pa.int32())
        names = self.names.take(pa.array(ids))
        return pc.binary_join(pa.ListArray.from_arrays(offsets, names), pa.scalar(" ", names.type)).to_pylist()

    def _plain_parts(self, word: str) -> list[str]:
        word = word.lower()
        parts = [word] if word.isalpha() else _PARTS.findall(word)
        return parts if word.isascii() else [p.encode().decode("latin-1").translate(self.bytes) for p in parts]

    def _library_parts(self, word: str) -> list[str]:
        normal = self.tokenizer.normalizer.normalize_str(word)
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal) if p]

    def _encode(self, words: list[str]) -> list[list[int]]:
        out: list = [None] * len(words)
        parts, owners = [], []
        together = "\n".join(words)
        special = any(t in together for t in self.added)
        for i, word in enumerate(words):
            if special and any(t in word for t in self.added):  # a special string stands for itself, wherever it is
                out[i] = self.tokenizer.encode(word, add_special_tokens=False).ids
            elif self.direct and word.isascii() and word.isalpha():  # most of what ``words`` leaves is one part
                parts.append(word.lower())
                owners.append(i)
            else:
                own = self._plain_parts(word) if self.direct and _PLAIN.fullmatch(word) else self._library_parts(word)
                parts += own
                owners += [i] * len(own)
        ids, counts = self.merges.encode(parts)
        sizes = np.bincount(np.array(owners, np.int64), counts, len(words)).astype(np.int64)
        ends = np.cumsum(sizes).tolist()
        flat = ids.tolist()
        for i, (end, size) in enumerate(zip(ends, sizes.tolist())):
            if out[i] is None:
                out[i] = flat[end - size : end]
        return out


@lru_cache(maxsize=1)
def _table(path: str) -> _Words:
    return _Words(path)


def _encoded(table: _Words, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    words, places, counts = table.words(texts)
    at = table.find(words)[places]
    ids, sizes = table.gather(at), sums_by_row(table.lengths(at), counts)
    return ids, sizes, table.decode(ids, sizes)


def encode_and_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (array of int, exactly the library's without special tokens) and ``decoded`` (what it makes of these ids).

    Words between spaces are split again at marks behind a letter, where the pre-tokeniser ends a part in any case; each
    distinct one is encoded once while a task's table holds it. Its parts are cut by greedy longest match over all
    tokens that merging gives for their own letters. That is the result of merging exactly if no two neighbours would
    have been joined across their border, which is checked for all distinct pairs of a batch at once; a part with such a
    pair goes through its merges in order of rank instead. For vocabularies with word ends whose white space is dropped;
    the file must exist at ``tokenizer_path`` on every executor. Special strings inside a text are their own token, as
    the library's default is. Null texts count as empty (no ids, empty text); rows repeat as in the input, null ids
    stay; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(tokenizer_path)
        for batch in batches:
            for a, texts in text_slices(batch.column(1)):
                ids, sizes, decoded = _encoded(table, texts)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), rows, pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").select(F.col("id").alias(id_col), "ids", "decoded")
