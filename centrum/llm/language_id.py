"""Language identification with interpolated Kneser-Ney character models held in sorted hash arrays."""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from centrum.llm.common import held, slices, stored, sums_by_row, texts_of, words_at_spaces

ORDER = 5
#: Length bands of the calibration, and the nats a character that a text may lie over its band's limit.
BANDS, MARGIN = 8, 1.4
_SPACE = 32
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


@dataclass
class Model:
    """One language: for each order the sorted hashes of n-grams with their discounted shares, and of contexts with their back-off shares."""

    name: str
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    unseen: float = 1e-4
    #: The highest accepted cross-entropy by length band, as far as it was calibrated.
    limits: dict[int, float] = field(default_factory=dict)

    def settle_limits(self) -> None:
        """A limit for every band: a longer text never has a higher one, and a band without texts has that of its shorter
        neighbour. Bands below all calibrated ones get a nat more each. ``MARGIN`` is added to all, as room for numbers, keys and
        names inside prose; without any text nothing is rejected."""
        first = min(self.limits, default=0)
        known, out = math.inf, {}
        for band in range(BANDS):
            known = min(known, self.limits.get(band, math.inf) + MARGIN)
            out[band] = known
        if self.limits:
            out |= {band: out[first] + first - band for band in range(first)}
        self.limits = out

    def log_shares(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of the last character of each row of ``ORDER`` codes, given those before it."""
        share = np.full(len(codes), self.unseen)
        for order in range(1, ORDER + 1):
            gram, context = _hashes(codes[:, ORDER - order :]), _hashes(codes[:, ORDER - order : ORDER - 1])
            share = _find(*self.grams[order - 1], gram, 0.0) + _find(*self.contexts[order - 1], context, 1.0) * share
        return np.log(share)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row; rows of other lengths are other keys."""
    out = np.full(len(codes), codes.shape[1], np.uint64)
    for k in range(codes.shape[1]):
        out = (out ^ codes[:, k].astype(np.uint64)) * _MULTIPLIERS[k]
        out ^= out >> np.uint64(29)
    return out


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def events(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What the models predict: rows of ``ORDER`` codes (four before, the last one predicted) and each row's word.

    Words are lower-cased; each run of letters stands between spaces; its letters and the space after it are predicted.
    """
    codes = np.frombuffer("\n".join([*words, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.cumsum(codes == 10) - (codes == 10)
    letter = _letters()[codes]
    padded = np.concatenate([np.full(ORDER - 1, _SPACE), np.where(letter, codes, _SPACE)])
    place = np.arange(len(codes))
    last_gap = np.maximum.accumulate(np.where(letter, -1, place))
    before = np.concatenate([[-1], last_gap[:-1]])
    wanted = np.flatnonzero(letter | (np.concatenate([[False], letter[:-1]]) & ~letter))
    rows = np.empty((len(wanted), ORDER), np.uint32)
    for k in range(ORDER):
        at = wanted - (ORDER - 1 - k)
        inside = (at > before[wanted]) | (k == ORDER - 1)
        rows[:, k] = np.where(inside, padded[at + ORDER - 1], _SPACE)
    return rows, owner[wanted]


def fit_model(name: str, grams: np.ndarray, counts: np.ndarray, alphabet: int) -> Model:
    """Interpolated Kneser-Ney shares from counts of distinct full-length rows; lower orders count distinct predecessors."""
    model = Model(name, unseen=1.0 / (alphabet + 1))
    tables = []
    for order in range(ORDER, 0, -1):
        tables.append((grams, counts))
        shorter, at = np.unique(grams[:, 1:], axis=0, return_inverse=True)
        grams, counts = shorter, np.bincount(at.ravel(), minlength=len(shorter)).astype(float)
    for grams, counts in reversed(tables):
        once, twice = float((counts == 1).sum()), float((counts == 2).sum())
        discount = once / (once + 2 * twice) if once and twice else 0.5
        _, at = np.unique(grams[:, :-1], axis=0, return_inverse=True) if grams.shape[1] > 1 else (None, np.zeros(len(grams), int))
        at = at.ravel()
        total, kinds = np.bincount(at, counts), np.bincount(at)
        first = np.unique(at, return_index=True)[1]
        model.grams.append(_sorted(_hashes(grams), np.maximum(counts - discount, 0) / total[at]))
        model.contexts.append(_sorted(_hashes(grams[:, :-1])[first], discount * kinds / total))
    return model


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order]


class Scorer:
    """Log probabilities of distinct words under every model, kept while the Python worker lives."""

    def __init__(self, models: list[Model], limit: int = 200_000, characters: int = 16_000_000):
        self.models, self.limit, self.characters = models, limit, characters
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.values = np.zeros((0, len(self.models) + 1), np.float32)
        self.held = 0

    def score(self, texts: list[str]) -> np.ndarray:
        """A row for each text: the sum of log probabilities under each model, and the number of predicted characters."""
        words, counts = words_at_spaces(texts)
        if len(self.place) > self.limit or self.held > self.characters:
            self.clear()
        new = list(dict.fromkeys(w for w in words if w not in self.place))
        for a, b in slices(new, 400_000):
            self._add(new[a:b])
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        return np.stack([sums_by_row(self.values[at, k].astype(np.float64), counts) for k in range(len(self.models) + 1)], axis=1)

    def _add(self, words: list[str]) -> None:
        rows, owner = events([w.replace("\n", "\t") for w in words])
        keys, first, at = np.unique(_hashes(rows), return_index=True, return_inverse=True)
        shares = np.stack([m.log_shares(rows[first]) for m in self.models] + [np.ones(len(first))], axis=1)
        have = len(self.place)
        self.place.update(zip(words, range(have, have + len(words))))
        self.held += sum(map(len, words))
        if have + len(words) > len(self.values):
            self.values = np.concatenate([self.values[:have], np.zeros((have + 2 * len(words), len(self.models) + 1), np.float32)])
        for k in range(len(self.models) + 1):
            self.values[have : have + len(words), k] = np.bincount(owner, shares[at, k], len(words))


def training_rows(df: DataFrame, per_language: int, id_col: str, lang_col: str) -> DataFrame:
    """About ``per_language`` labelled rows of each language, drawn by a hash of the id; all, where there are fewer."""
    sizes = df.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).count()
    shares = {r["lang"]: min(1.0, per_language / r["count"]) for r in sizes.toLocalIterator()}
    if not shares:
        return df.where("false")
    share = F.element_at(F.create_map(*(F.lit(x) for pair in shares.items() for x in pair)), F.col(lang_col))
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("language sample")), F.lit(1 << 30)) / (1 << 30)
    return df.where(F.col(lang_col).isNotNull() & (place < share))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 5000) -> list[Model]:
    """A model for each language of the labelled rows, from a sample of about ``per_language`` rows each.

    That bound, the only one, is on labelled rows: all n-grams of the sampled texts count, so discounts and continuation
    counts are those of the whole sample. Counting runs in tasks, and so does the fit, by language; the
    driver sees the finished sorted arrays (some MB a language). A fifth of the sample is left out of the counts and calibrates
    what is rejected: by length bands, the quantile of its texts' cross-entropy that only one in a thousand passes.
    """
    sample = training_rows(df.select(id_col, text_col, lang_col), per_language, id_col, lang_col)
    rows = stored(sample.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), (F.pmod(F.xxhash64(id_col), F.lit(5)) == 0).alias("tune")), "language-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), object)
            texts = texts_of(batch.column(1))
            for a, b in slices(texts):
                for name in dict.fromkeys(lang[a:b]):
                    words = Counter(w for i in range(a, b) if lang[i] == name for w in texts[i].split())
                    found, owner = events(list(words))
                    each = np.fromiter(words.values(), np.float64, len(words))
                    kinds, at = np.unique(found, axis=0, return_inverse=True)
                    sums = np.bincount(at.ravel(), each[owner], len(kinds)).astype(np.int64)
                    grams = ["".join(map(chr, k)) for k in kinds]
                    yield pa.RecordBatch.from_pydict({"lang": [name] * len(kinds), "gram": grams, "n": sums})

    counted = rows.where("not tune").select("lang", "text").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    fitted = stored(counted, "language-grams").groupBy("lang").applyInArrow(_fit_language, "lang string, model binary")
    models = [pickle.loads(r["model"]) for r in stored(fitted, "language-models").orderBy("lang").toLocalIterator()]
    if models:
        scored = score(rows.where("tune").withColumn("row", F.monotonically_increasing_id()), models, "row", "text", ["lang"])
        own = scored.where("n > 0 and lang = lang_pred").select("lang_pred", "cross_entropy", length_band(F.col("n")).alias("band"))
        limits = own.groupBy("lang_pred", "band").agg(F.percentile_approx("cross_entropy", 0.999, 10_000).alias("limit"), F.max("cross_entropy").alias("most"), F.count("*").alias("n"))
        by_name = {m.name: m for m in models}
        for r in limits.toLocalIterator():
            # with few texts the quantile is their maximum, which the next text passes with chance 1 / (n + 1)
            by_name[r["lang_pred"]].limits[r["band"]] = r["limit"] if r["n"] >= 1000 else r["most"] + 3.0 / math.sqrt(r["n"])
        for m in models:
            m.settle_limits()
    return models


def _fit_language(table: pa.Table) -> pa.Table:
    codes = np.frombuffer("".join(table.column("gram").to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)
    name = table.column("lang")[0].as_py()
    model = fit_model(name, codes, table.column("n").to_numpy().astype(float), len(np.unique(codes)))
    return pa.table({"lang": [name], "model": pa.array([pickle.dumps(model)], pa.binary())})


def length_band(n: Column) -> Column:
    """Texts of up to 16, 32, ... characters, by number; the last band has no end."""
    return F.least(F.greatest(F.ceil(F.log2(n / 16.0)), F.lit(0)), F.lit(BANDS - 1)).cast("int")


def _scorer(models: Broadcast) -> Scorer:
    """The scorer of these models: a worker builds it once."""
    return held(("scorer", id(models.value)), lambda: Scorer(models.value))


def score(df: DataFrame, models: list[Model], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` (0 to 1), ``cross_entropy`` (nats a character), ``n`` characters, ``accepted``.

    The language with the lowest length-normalised cross-entropy wins; ties go to the first name. ``score`` is that
    language's share when the models' log probabilities are tempered by the square root of the length. A text is not
    accepted when its cross-entropy lies over the limit that calibration found for its language and length. Texts without a letter, null and empty ones get
    ``und``, score 0, no cross-entropy, and are not accepted. Rows repeat as in the input; only the named columns are read.
    A text that is kept is sent once.
    """
    keep = keep or []
    sent = lambda k: "text" if k == text_col else f"kept_{k}"
    shared = df.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        names = np.array([m.name for m in scorer.models] + ["und"], object)
        limits = np.array([[m.limits.get(b, math.inf) for b in range(BANDS)] for m in scorer.models] + [[math.inf] * BANDS])
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in slices(texts):
                sums = scorer.score(texts[a:b])
                n = sums[:, -1]
                some = (n > 0) & (len(scorer.models) > 0)
                logs = sums[:, :-1] if len(scorer.models) else np.zeros((b - a, 1))
                best = np.where(some, logs.argmax(axis=1), len(scorer.models))
                entropy = -logs.max(axis=1) / np.maximum(n, 1)
                tempered = (logs - logs.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(n, 1))[:, None]
                share = np.where(some, 1 / np.exp(tempered).sum(axis=1), 0.0)
                band = np.clip(np.ceil(np.log2(np.maximum(n, 1) / 16)), 0, BANDS - 1).astype(int)
                accepted = some & (entropy <= limits[best, band])
                out = {"id": batch.column("id").slice(a, b - a), "lang_pred": pa.array(names[best], pa.string()), "score": share}
                out |= {"cross_entropy": pa.array(entropy, mask=~some), "n": n.astype(np.int64), "accepted": accepted}
                yield pa.RecordBatch.from_pydict(out | {f"kept_{k}": batch.column(sent(k)).slice(a, b - a) for k in keep})

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(k).alias(f"kept_{k}") for k in keep if k != text_col))
    kinds = [("id", id_col), *((f"kept_{k}", k) for k in keep)]
    types = {n: df.schema[c].dataType.simpleString() for n, c in kinds}
    schema = f"id {types['id']}, lang_pred string, score double, cross_entropy double, n long, accepted boolean" + "".join(f", kept_{k} {types[f'kept_{k}']}" for k in keep)
    out = rows.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", "cross_entropy", "n", "accepted", *(F.col(f"kept_{k}").alias(k) for k in keep))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model may learn from: CRC-32 of the id's text leaves 2 when divided by 4. Null ids aren't held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
