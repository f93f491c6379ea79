"""Positions of regular-expression matches, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def matches(text: Column, kind: str, pattern: str, needs: Column, group: int = 0) -> Column:
    """An array of (kind, nth, gap, value, part) for the leftmost non-overlapping matches, in order; empty unless ``needs``.

    ``gap`` is the text since the match before, ``part`` a group of the pattern (all of it for 0). Every step begins where
    the last match ended, so a text is walked once, and a text without another match isn't searched again from each place.
    """
    stepped = F.lit(rf"(?s)\G(.*?)({pattern})")
    gaps, values, parts = (F.regexp_extract_all(text, stepped, F.lit(i)) for i in (1, 2, group + 2))
    zipped = F.transform(
        F.arrays_zip(gaps.alias("gap"), values.alias("value"), parts.alias("part")),
        lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), m["gap"].alias("gap"), m["value"].alias("value"), m["part"].alias("part")),
    )
    none = F.array().cast("array<struct<kind:string,nth:int,gap:string,value:string,part:string>>")
    return F.when(needs, zipped).otherwise(none)


def located(rows: DataFrame, found: list[Column], keep: list[str]) -> DataFrame:
    """One row for each match: ``keep``, kind, start, end (code points, end exclusive), value, part, before and after.

    ``rows`` has a column ``row`` that tells its rows apart. Rows without a match give one row with null in ``kind``.
    Only matches are shuffled, by row, to add up what lies before each of them.
    """
    each = rows.select("row", *keep, F.explode_outer(F.concat(*found)).alias("m"))
    short = each.select(
        "row", *keep, F.col("m.kind").alias("kind"), F.col("m.nth").alias("nth"), F.col("m.value").alias("value"), F.col("m.part").alias("part"),
        F.char_length("m.gap").alias("gap"), F.char_length("m.value").alias("size"), F.right("m.gap", F.lit(48)).alias("before"), F.left("m.gap", F.lit(32)).alias("head"),
    )
    order = Window.partitionBy("row", "kind").orderBy("nth")
    end = F.sum(F.col("gap") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return short.select(
        "row", *keep, "kind", (end - F.col("size")).alias("start"), end.alias("end"), "value", "part", "before", F.lead("head").over(order).alias("after")
    )


def with_row(df: DataFrame) -> DataFrame:
    """Rows told apart by a number that a repeated task gives again."""
    return df.withColumn("row", F.monotonically_increasing_id())


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def gathered(kinds: list[str], only: Column | None = None, **more: Column) -> Column:
    """The spans of a group by start, then by the order of ``kinds``, as structs; those for which ``only`` holds."""
    place = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(kinds) for x in (k, i))), F.col("kind"))
    span = F.struct("start", place.alias("place"), "end", "kind", *(c.alias(n) for n, c in more.items()))
    wanted = F.col("kind").isNotNull() if only is None else F.col("kind").isNotNull() & only
    return F.sort_array(F.collect_list(F.when(wanted, span)))
