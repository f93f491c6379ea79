"""Secret scans: candidates are judged by how many repositories and owners share their value across the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from centrum.llm.common import stored
from centrum.llm.spans import gathered, located, matches, with_row

#: The base patterns. A match is dropped, without another try, if it is too short. Access keys and hex runs
#: are asked for with their least length at once: a run that is too short holds no longer match inside.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
#: Forms of well-known providers, added to the base patterns.
PROVIDER = r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
KINDS = ["assign", "access", "hex", "provider"]
#: A value with so many owners, or repositories, is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 5
#: Up to so many values (some 30 MB) the ownership table is broadcast; a larger one is joined over salted values.
BROADCAST_VALUES, SALTS = 200_000, 32
_PLACEHOLDER = r"(?i)example|sample|dummy|changeme|your[_-]|placeholder|^(.)\1*$"


def candidates(df: DataFrame, id_col: str, text_col: str, owner_col: str | None, repo_col: str | None) -> DataFrame:
    """A row for each candidate span, or one with null in ``kind`` for a text without any."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    owner = (F.col(owner_col).cast("string") if owner_col else F.lit(None).cast("string")).alias("owner")
    repo = (F.col(repo_col).cast("string") if repo_col else F.lit(None).cast("string")).alias("repo")
    rows = with_row(df.select(F.col(id_col).alias("id"), text.alias("text"), owner, repo))
    t = F.col("text")
    found = [
        matches(t, "assign", ASSIGN, t.rlike(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"), group=1),
        matches(t, "access", ACCESS, t.contains("AKIA")),
        matches(t, "hex", HEX, t.rlike("[0-9a-f]{32}")),
        matches(t, "provider", PROVIDER, t.rlike(r"gh[pousr]_|xox[abprs]-|AIza|sk_live_|eyJ")),
    ]
    all_found = located(rows, found, ["id", "owner", "repo"])
    size = F.char_length("part")
    fits = ((F.col("kind") == "assign") & (size >= 8)) | ((F.col("kind") == "access") & (size >= 16)) | ((F.col("kind") == "hex") & (size >= 32)) | (F.col("kind") == "provider")
    kept = F.when(fits, F.col("kind"))
    return all_found.select("row", "id", "owner", "repo", kept.alias("kind"), "start", "end", F.when(fits, F.col("part")).alias("secret"))


def ownership(found: DataFrame) -> DataFrame:
    """Each ``value`` (hash of a candidate) with its distinct ``owners`` and ``repositories``; each is counted once per task first."""
    held = found.select("value", "owner", "repo").distinct()
    by_owner = held.groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = None) -> DataFrame:
    """``id_col`` and ``spans``: array of (start, place, end, kind, live, owners, repositories) by start, then kind.

    Candidates of the base kinds assign, access and hex are always kept; a provider's form is kept if it is live. ``live``
    means: specific to its owner. A value that at least 3 owners or 5 repositories hold, or that reads like a
    placeholder, is a copied example. Positions count code points, the end is exclusive. A null text is empty; a null owner or repository counts as
    one of its own; each input row gives one row, repeated and null ids too; no rows for an empty table; other columns aren't read.
    """
    found = stored(candidates(df, id_col, text_col, owner_col, repo_col), "secret-candidates")
    valued, rest = found.where("kind is not null").withColumn("value", F.sha2("secret", 256)), found.where("kind is null")
    owned = stored(ownership(valued), "secret-owners")
    none = F.lit(None).cast("long")
    shared = F.coalesce((F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES), F.lit(False))
    judged = _with_owners(valued, owned).unionByName(rest.select("*", none.alias("owners"), none.alias("repositories")), allowMissingColumns=True)
    judged = judged.withColumn("live", F.coalesce(~shared & ~F.col("secret").rlike(_PLACEHOLDER), F.lit(False)))
    kept = gathered(KINDS, (F.col("kind") != "provider") | F.col("live"), live=F.col("live"), owners=F.col("owners"), repositories=F.col("repositories"))
    return judged.groupBy("row").agg(F.min("id").alias(id_col), kept.alias("spans")).drop("row")


def _with_owners(valued: DataFrame, owned: DataFrame) -> DataFrame:
    """Candidates with the counts of their value; one value may be in a third of all rows."""
    if owned.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES:
        return valued.join(F.broadcast(owned), "value")
    salted = owned.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return valued.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["value", "salt"]).drop("salt")


def redacted(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = s["start"] - state["at"]
        fresh = F.concat(state["out"], F.substr(text, (state["at"] + 1).cast("int"), gap.cast("int")), F.lit(mark))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(gap >= 0, fresh).otherwise(state["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda state: F.concat(state["out"], F.substr(text, (state["at"] + 1).cast("int"), F.char_length(text))))
