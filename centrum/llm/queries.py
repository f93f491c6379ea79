"""Registered queries: one for each operator, over its whole table, with the columns that its contract names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from centrum.llm import bpe, collocations, html_text, language_id, maxscore, minhash, packing, personal_data, pieces, projected_neighbours, ranked_search, secret_scan, token_counts
from centrum.llm.spans import as_text

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_language_id")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of all documents, from models that learn only from rows that are not held out."""
    docs = table(spark, folder, "documents")
    models = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.score(docs, models)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


@query("op5_token_counts")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of all documents."""
    found = token_counts.with_token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query("op7_piece_encoding")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Piece ids of all documents and the texts they decode to, as digests."""
    found = pieces.encode_and_decode(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query("op10_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 2,048 tokens."""
    encoded = packing.word_ids(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    packed = packing.pack(encoded, window=2048)
    return packed.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def _of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _span_columns(spans: str, base: list[str]) -> list[Column]:
    own = F.filter(spans, lambda s: s["kind"].isin(base))
    counts = [F.size(_of_kind(spans, k)).cast("long").alias(f"n_{k}") for k in base]
    return [*counts, F.sha2(as_text(own), 256).alias("base_sha256"), as_text(F.col(spans)).alias("spans")]


@query("op2_secret_scan")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of all documents; sources are owners, and a source's languages are its repositories."""
    found = secret_scan.scan(table(spark, folder, "documents"), repo_col="lang")
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live")
    return found.select("doc_id", *_span_columns("spans", ["assign", "access", "hex"]), live)


@query("op8_near_duplicates")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose sets of three-word shingles are alike to 85 per cent, directly or over others."""
    return minhash.near_duplicates(table(spark, folder, "documents"), size=3, per_cent=85)


@query("op9_personal_data")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of all documents."""
    found = personal_data.scan(table(spark, folder, "documents"))
    return found.select("doc_id", *_span_columns("spans", ["email", "ip", "card", "phone"]))


@query("op4_projected_neighbours")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth one."""
    return projected_neighbours.nearest(table(spark, folder, "embeddings"), every=20, k=20)


SQL_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER o AS INTEGER) AS rank, vec_id, score FROM s
WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER o <= 20
"""


@query("op6_maxscore_top_k", SQL_TOP_K)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """The exact 20 highest integer scores for every twentieth vector."""
    return maxscore.exact_top_k(table(spark, folder, "embeddings"), every=20, k=20)


@query("op3_main_text")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Main texts of all pages."""
    found = html_text.extract(table(spark, folder, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op12_bpe_encoding")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Byte-pair ids of all documents and what they decode to, as digests."""
    found = bpe.encode_and_decode(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
SQL_RANKED = f"""
WITH t AS (SELECT row, doc_id, {_TERMS} FROM (SELECT row_number() OVER () AS row, * FROM documents)
), d AS (SELECT row, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY row
), s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d
), p AS (SELECT row, term, count(*) AS tf FROM t GROUP BY ALL
), q AS (SELECT DISTINCT item_id, {_TERMS} FROM benchmark
), w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term
), f AS (
  SELECT item_id, d.doc_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (row), s GROUP BY ALL HAVING score > 0
)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM f
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 10
"""


@query("op13_ranked_search", SQL_RANKED)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """The ten highest-scoring documents for every benchmark item."""
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


SQL_PHRASES = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS pc, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), places AS (SELECT lang, pc, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM pieces
), runs AS (
  SELECT lang, w AS g1, g1 || ' ' || lead(w, 1) OVER o AS g2, g2 || ' ' || lead(w, 2) OVER o AS g3, g3 || ' ' || lead(w, 3) OVER o AS g4, g4 || ' ' || lead(w, 4) OVER o AS g5
  FROM places WINDOW o AS (PARTITION BY pc ORDER BY i)
), f AS (
  SELECT lang, 1 AS m, g1 AS phrase, count(*) AS f FROM runs GROUP BY ALL UNION ALL SELECT lang, 2, g2, count(*) FROM runs WHERE g2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, g3, count(*) FROM runs WHERE g3 IS NOT NULL GROUP BY ALL UNION ALL SELECT lang, 4, g4, count(*) FROM runs WHERE g4 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 5, g5, count(*) FROM runs WHERE g5 IS NOT NULL GROUP BY ALL
), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang
), c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 100
), k AS (
  SELECT c.lang, c.phrase, c.m, a, n, h.f AS l, t.f AS r, k, CAST((1000::HUGEINT * a * n) // (h.f::HUGEINT * t.f) AS BIGINT) AS score
  FROM c JOIN n USING (lang), range(1, 5) x(k) JOIN f h ON h.lang = c.lang AND h.m = k AND h.phrase = array_to_string(w[1:k], ' ')
  JOIN f t ON t.lang = c.lang AND t.m = c.m - k AND t.phrase = array_to_string(w[k + 1:], ' ') WHERE k < c.m
), b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), d AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.lang = b.lang AND o.m > b.m AND o.a >= b.a AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n, score FROM d
WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER o <= 2000
"""


@query("op11_collocations", SQL_PHRASES)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """The 2,000 highest-scoring phrases of each language that lie in no longer phrase of the same count."""
    found = collocations.phrases(table(spark, folder, "documents"), least=100).where("best_left < a and best_right < a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 2000")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
