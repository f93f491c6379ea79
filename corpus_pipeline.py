"""A corpus from raw documents to packed sequences: each stage is written as Parquet and read again by the next one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from centrum.llm import language_id, minhash, packing, secret_scan
from centrum.session import scratch_path


def _whole(docs: DataFrame) -> DataFrame:
    """Rows as ``key``, ``content`` and ``row``, all columns in one, so that no column's name can clash with a stage's own."""
    return docs.select(F.col("doc_id").alias("key"), F.col("text").alias("content"), F.struct(*docs.columns).alias("row"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept; the others go: no letter (null and empty texts too), or far from all languages.

    Repeated rows and null ids stay as they are; an empty table stays empty."""
    models = language_id.fit(docs.where(~language_id.held_out()))
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.col("doc_id").alias("key"), F.col("text").alias("content"), F.struct(*rest).alias("row"))
    found = language_id.score(rows, models, "key", "content", keep=["content", "row"])
    return found.where("accepted").select(*[F.col("content").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Repeated rows of one id and text become one, and so do documents without an id that have the same text; these stand
    behind all ids. Texts without words stay; an empty table stays empty.
    """
    keyed = _whole(docs).withColumn("key", F.coalesce("key", F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("content"), 2)))
    groups = minhash.near_duplicates(keyed, id_col="key", text_col="content", size=5, per_cent=80)
    stay = groups.where("kept").select("key").distinct()
    once = keyed.join(stay, "key", "left_semi").withColumn("same", F.xxhash64("content")).dropDuplicates(["key", "same"])
    return once.select("row.*")


def hide_live_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets that look live are replaced by a mark, widely copied examples stay as they are.

    Null texts stay null; rows of one id and text get the same text; an empty table stays empty."""
    keyed = _whole(docs).withColumn("key", F.concat_ws(":", F.col("row.doc_id").cast("string"), F.xxhash64("content").cast("string")))
    keyed = keyed.withColumn("owner", F.col("row.source")).withColumn("repo", F.col("row.lang"))
    live = F.filter("spans", lambda s: s["live"])
    found = secret_scan.scan(keyed, "key", "content", "owner", "repo").select("key", live.alias("spans"))
    hidden = keyed.join(found.where(F.size("spans") > 0).dropDuplicates(["key"]), "key", "left")
    some = F.col("spans").isNotNull()
    clean = secret_scan.redacted(F.col("content"), F.col("spans"))
    text = F.when(some, clean).otherwise(F.col("content"))
    new = {"text": text, "n_chars": F.when(some, F.char_length(clean).cast("long")).otherwise(F.col("row.n_chars"))}
    return hidden.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids in sequences of at most 2,048: one row a piece, as ``packing.pack`` returns them.

    A null text is empty and gives its end id alone; each repeated row is packed; an empty table gives no rows."""
    encoded = packing.word_ids(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    packed = packing.pack(encoded, window=2048)
    return packed.select(F.col("id").alias("doc_id"), "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", keep_one_of_each_group),
    ("secret_scan", hide_live_secrets),
    ("packing", pack_sequences),
]

#: Language models and packing have no SQL form; tests compare the stages with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
