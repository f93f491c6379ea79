"""Column expressions shared by the operators; all of them stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_RANGE = 4294967296


def row_hash(key: Column | str, *salt) -> Column:
    """A 32-bit number from the md5 of ``salt:...:key``; the same number in any SQL engine."""
    key = F.col(key) if isinstance(key, str) else key
    parts = [s if isinstance(s, Column) else F.lit(str(s)) for s in salt]
    text = F.concat_ws(":", *[p.cast("string") for p in parts], key.cast("string"))
    # never null: said so, because a null check pushed into the scan would hash every row twice
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))


def whole_div(left: Column, right) -> Column:
    """Integer division of non-negative whole numbers, exact for 64-bit values."""
    right = right if isinstance(right, Column) else F.lit(right)
    left, right = left.cast("bigint"), right.cast("bigint")
    return F.coalesce(((left - left % right) / right).cast("bigint"), F.lit(0).cast("bigint"))


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def dot(left: Column, right: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def ratio(num: Column, den: Column, empty=0.0) -> Column:
    """num/den as double; ``empty`` where the denominator is zero (None gives null)."""
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(empty).cast("double"))


def hard_label(score: Column, threshold, inclusive: bool = False) -> Column:
    """1 when the score passes the threshold (strictly by default), else 0."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return ((score >= threshold) if inclusive else (score > threshold)).cast("int")


def positive_probability(prob: Column, is_array: bool) -> Column:
    """The positive-class probability of a (negative, positive) pair, or the score itself."""
    return F.element_at(prob, 2) if is_array else prob


def clean_key(text: Column) -> Column:
    """Trimmed text with blanks turned into underscores."""
    return F.regexp_replace(F.trim(text), " ", "_")


def group_letter(index: Column) -> Column:
    """A..Z for the indices 0..25, then G27, G28, ..."""
    return F.when(index < 26, F.chr(index + 65)).otherwise(F.concat(F.lit("G"), (index + 1).cast("string")))


def number_or_null(col: Column) -> Column:
    """The column as a double; what is not a number becomes null."""
    return col.try_cast("double")


def recode_negative(label: Column) -> Column:
    """-1 becomes 0, other labels stay."""
    return F.when(label == -1, F.lit(0.0)).otherwise(label.cast("double"))


def equal_chunk(rank0: Column, total: Column, chunks: int) -> Column:
    """Chunk number of a 0-based rank when ``total`` rows fall into ``chunks`` near-equal runs,
    the first ``total mod chunks`` runs being one row longer."""
    size = whole_div(total, chunks)
    longer = total % chunks
    head = longer * (size + 1)
    return F.when(rank0 < head, whole_div(rank0, size + 1)).otherwise(
        longer + whole_div(rank0 - head, F.greatest(size, F.lit(1)))
    ).cast("int")
