"""Personal data: patterns propose spans, checksums confirm them, and words nearby move their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from centrum.llm.spans import gathered, located, matches, with_row

#: The base patterns, written so that no place is tried twice.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Account numbers (two letters, two check digits) and social security numbers, added to the base patterns.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
#: Words near a span that speak for it.
CONTEXT = {
    "email": "e-?mail|contact|write|courriel|correo", "ip": "ip|host|server|address", "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax", "iban": "iban|account|bank|konto|compte|cuenta", "ssn": "ssn|social|security",
}
_BASE_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8, "ssn": 0.2}
#: Below this score a span outside the base kinds isn't reported.
LEAST = 0.5


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def step(total: Column, i: Column) -> Column:
        digit = F.substr(digits, -i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), step) % 10 == 0


def mod_97(account: Column) -> Column:
    """Whether letters and digits, the first four moved to the end and letters read as 10 to 35, leave 1 when divided by 97."""
    plain = F.regexp_replace(account, r"\x20", "")
    moved = F.concat(F.substr(plain, F.lit(5), F.char_length(plain)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c))) == 1


def _confirmed() -> Column:
    digits = F.regexp_replace("value", "[^0-9]", "")
    n = F.char_length(digits)
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    return (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", F.col("value").rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(F.col("kind") == "card", F.when(n.between(12, 19), luhn(digits)).otherwise(False))
        .when(F.col("kind") == "phone", n.between(9, 15))
        .when(F.col("kind") == "iban", mod_97(F.col("value")))
        .when(F.col("kind") == "ssn", ~F.col("value").rlike("^(?:000|666|9)|-00-|-0000$"))
        .otherwise(False)
    )


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans``: array of (start, place, end, kind, score) by start, then kind, for every whole text.

    Base kinds (email, ip, card, phone) stay whenever their own rule confirms them; iban and ssn are added if their
    checks hold and the score reaches 0.5. The score starts at a value for the kind and rises by 0.2 for a checksum and by
    0.3 for a context word within 48 code points before or 32 after (up to the next match of its kind). Null texts are empty; each input row gives
    one row, repeated and null ids too; an empty table gives none; other columns aren't read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = with_row(df.select(F.col(id_col).alias("id"), text.alias("text")))
    t = F.col("text")
    found = [
        matches(t, "email", EMAIL, t.contains("@")),
        matches(t, "ip", IP, t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")),
        matches(t, "card", CARD, t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")),
        matches(t, "phone", PHONE, t.rlike(r"\+[0-9]")),
        matches(t, "iban", IBAN, t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}")),
        matches(t, "ssn", SSN, t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")),
    ]
    near = F.concat_ws(" ", "before", "after")
    context = F.coalesce(*(F.when(F.col("kind") == k, near.rlike(rf"(?i)(?<![a-z])(?:{w})")) for k, w in CONTEXT.items()), F.lit(False))
    base = F.coalesce(*(F.when(F.col("kind") == k, F.lit(s)) for k, s in _BASE_SCORE.items()))
    checked = F.when(F.col("kind").isin("card", "iban"), 0.2).otherwise(0.0)
    score = F.round(F.least(F.lit(1.0), base + checked + F.when(context, 0.3).otherwise(0.0)), 2)
    judged = located(rows, found, ["id"]).withColumn("ok", _confirmed()).withColumn("score", score)
    kept = gathered(KINDS, F.col("ok") & (F.col("kind").isin("email", "ip", "card", "phone") | (F.col("score") >= LEAST)), score=F.col("score"))
    return judged.groupBy("row").agg(F.min("id").alias(id_col), kept.alias("spans")).drop("row")
