"""Queries over vectors, benchmark items and conversations: name -> (function, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import dedupe, retrieve, validate, vector_index
from textloom.queries.documents import r6, spread, table

HITS_SQL = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, label, list_cosine_similarity(qe, e) AS score FROM q, v),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5)"""


def hits(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Every vector whose id is divisible by 50 is a query; the search is over all."""
    v = table(spark, sf_dir, "embeddings")
    return retrieve.top_k(v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v, k)


def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", r6(F.col("score")).alias("score"))


def vec_topk_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-09, SRT-01 through the index of clusters: the same rows as vec_topk."""
    v = table(spark, sf_dir, "embeddings")
    found, _ = vector_index.top_k_indexed(v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v, 5)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", r6(F.col("score")).alias("score"))


def index_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MSR-27 of the vectors as chunks, runs of 100 ids and one of their hashes."""
    return validate.content_hash(table(spark, sf_dir, "embeddings").select(F.concat(F.lit("chunk-"), F.col("vec_id").cast("string")).alias("chunk_id")), "chunk_id", 100, two_levels=True)


INDEX_CONTENT_HASH = """WITH i AS (SELECT DISTINCT 'chunk-' || vec_id AS h FROM embeddings), a AS (SELECT h, row_number() OVER (ORDER BY h) - 1 AS n FROM i), b AS (SELECT n // 100 AS run, sha1(string_agg(h, chr(10) ORDER BY n)) AS h FROM a GROUP BY run)
SELECT CASE WHEN count(*) > 1 THEN sha1(string_agg(h, chr(10) ORDER BY run)) ELSE max(h) END AS hash, (SELECT count(*) FROM i) AS rows FROM b"""


def vec_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = retrieve.confidence(hits(spark, sf_dir))
    return c.select("query_id", "n", r6(F.col("best")).alias("best"), r6(F.col("top3")).alias("top3"), r6(F.col("confidence")).alias("confidence"), "label")


VEC_CONFIDENCE = f"""WITH {HITS_SQL}, c AS (SELECT query_id, count(*) AS n, max(score) AS best, avg(CASE WHEN rank <= 3 THEN score END) AS top3 FROM h GROUP BY query_id)
SELECT query_id, n, round(best, 6) AS best, round(top3, 6) AS top3, round(best * 0.55::DOUBLE + top3 * 0.35::DOUBLE + least(n, 5) / 5 * 0.10::DOUBLE, 6) AS confidence,
  CASE WHEN best >= 0.45 AND top3 >= 0.38 AND n >= 3 THEN 'high' WHEN best >= 0.34 AND top3 >= 0.28 THEN 'medium' ELSE 'low' END AS label FROM c"""


def vec_source_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return retrieve.source_rollup(h, "label").withColumn("best", r6(F.col("best")))


VEC_SOURCE_ROLLUP = f"WITH {HITS_SQL} SELECT query_id, label, round(max(score), 6) AS best, count(*) AS n, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rank) AS chunks FROM h GROUP BY query_id, label"

FOUND_SQL = """a AS (SELECT item_id AS query_id, string_split(lower(text), ' ') AS ws FROM benchmark), t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
f AS (SELECT query_id, doc_id AS article_id, len(list_filter(ws, lambda w: contains(t, w))) AS hits FROM a, t), g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, article_id) AS rank FROM f WHERE hits > 0 QUALIFY rank <= 3)"""


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    d = spread(table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("article_id"), F.coalesce("text", F.lit("")).alias("text"))
    return retrieve.lexical(q, d)


def lexical_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("query_id", "article_id", F.col("hits").cast("long").alias("hits"), F.col("rank").cast("long").alias("rank"))


def _context(spark: SparkSession, sf_dir: str, budget: int, **how) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text")
    c = retrieve.context(found(spark, sf_dir).join(d, "article_id"), budget, **how)
    return c.select("query_id", "blocks", F.md5("context").alias("context"))


def context_budget_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir, 18_000, first_always=True)


def context_budget_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir, 40_000, first_always=False, separator=2)


def _context_sql(budget: int, first: str, sep: int, joint: str) -> str:
    return f"""WITH {FOUND_SQL}, x AS (SELECT query_id, rank, text, sum(length(text) + {sep}) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM g JOIN documents ON doc_id = article_id),
y AS (SELECT *, min(CASE WHEN used > {budget} {first} THEN rank END) OVER (PARTITION BY query_id) AS cut FROM x)
SELECT query_id, count(*) AS blocks, md5(string_agg(text, {joint} ORDER BY rank)) AS context FROM y WHERE cut IS NULL OR rank < cut GROUP BY query_id"""


def retrieval_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    grounded = hits(spark, sf_dir).filter("score < 0.999 and score >= 0.4").select((F.col("query_id") / 50).cast("long").alias("query_id"), "rank", F.col("vec_id").alias("item"), "score")
    lexical = found(spark, sf_dir).select("query_id", "rank", F.col("article_id").alias("item"), F.col("hits").cast("double").alias("score"))
    out = retrieve.cascade(q, grounded, lexical)
    return out.select("query_id", F.col("source").cast("long").alias("source"), F.col("rank").cast("long").alias("rank"), "item", r6(F.col("score")).alias("score"))


RETRIEVAL_CASCADE = f"""WITH {HITS_SQL}, {FOUND_SQL}, u AS (SELECT query_id // 50 AS query_id, 0 AS source, rank, vec_id AS item, score FROM h WHERE score < 0.999 AND score >= 0.4 UNION ALL SELECT query_id, 1, rank, article_id, CAST(hits AS DOUBLE) FROM g),
m AS (SELECT *, min(source) OVER (PARTITION BY query_id) AS first FROM u)
SELECT a.query_id, CAST(source AS BIGINT) AS source, rank, item, round(score, 6) AS score FROM a LEFT JOIN (SELECT * FROM m WHERE source = first) USING (query_id)"""


def hit_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-07/08: three times k are fetched; hits of one label's parity count as one text."""
    h = hits(spark, sf_dir, 15).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return retrieve.dedupe_hits(h, 5, "vec_id", "label").select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id")


HIT_DEDUPE = f"""WITH {HITS_SQL.replace('rank <= 5', 'rank <= 15')}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS r FROM h), c AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM b WHERE r = 1)
SELECT query_id, rank, vec_id FROM c WHERE rank <= 5"""


def index_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return validate.index_checks(v, vec_id="vec_id", chunk_id="vec_id", vector="embedding", dim=64)


INDEX_VALIDATION = """WITH a AS (SELECT count(*) AS rows, count(*) FILTER (WHERE len(embedding) <> 64) AS bad_dim, CAST(0 AS BIGINT) AS empty_texts, count(DISTINCT vec_id) AS ids, min(vec_id) AS low, max(vec_id) AS high, count(DISTINCT vec_id) AS vec_ids FROM embeddings),
b AS (SELECT *, array_to_string(list_filter([CASE WHEN bad_dim > 0 THEN 'wrong_dimension' END, CASE WHEN ids <> rows THEN 'duplicate_chunk_id' END, CASE WHEN NOT (low = 0 AND high = rows - 1 AND vec_ids = rows) THEN 'vector_ids_not_sequential' END], lambda x: x IS NOT NULL), ',') AS errors FROM a)
SELECT *, errors = '' AS ok FROM b"""


def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return dedupe.only_new(v.select("vec_id", "label"), v.filter("label % 2 = 0"), "vec_id")


def intake_session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13/14, WIN-02: a conversation is a session and a turn an item; a later equal text is a duplicate."""
    c = table(spark, sf_dir, "conversations").withColumn("k", F.sha1(X.hash_key(F.coalesce("text", F.lit("")))))
    first = c.groupBy("conv_id", "k").agg(F.min("turn").alias("first"))
    c = c.join(first, ["conv_id", "k"])
    counts = [F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("system", "user", "assistant")]
    return c.groupBy("conv_id").agg(F.count("*").alias("items"), *counts, F.count_if(F.col("turn") > F.col("first")).alias("duplicates"), F.sum(F.length("text")).alias("chars"))


INTAKE = """WITH a AS (SELECT *, row_number() OVER (PARTITION BY conv_id, trim(lower(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' ') ORDER BY turn) AS r FROM conversations)
SELECT conv_id, count(*) AS items, count(*) FILTER (WHERE role = 'system') AS n_system, count(*) FILTER (WHERE role = 'user') AS n_user, count(*) FILTER (WHERE role = 'assistant') AS n_assistant, count(*) FILTER (WHERE r > 1) AS duplicates, CAST(sum(length(text)) AS BIGINT) AS chars FROM a GROUP BY conv_id"""

QUERIES = {
    "index_content_hash": (index_content_hash, INDEX_CONTENT_HASH),
    "vec_topk_indexed": (vec_topk_indexed, f"WITH {HITS_SQL} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM h"),
    "vec_topk": (vec_topk, f"WITH {HITS_SQL} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM h"), "vec_confidence": (vec_confidence, VEC_CONFIDENCE), "vec_source_rollup": (vec_source_rollup, VEC_SOURCE_ROLLUP),
    "lexical_top3": (lexical_top3, f"WITH {FOUND_SQL} SELECT query_id, article_id, CAST(hits AS BIGINT) AS hits, rank FROM g"),
    "context_budget_a": (context_budget_a, _context_sql(18_000, "AND rank > 1", 0, "''")), "context_budget_b": (context_budget_b, _context_sql(40_000, "", 2, "chr(10) || chr(10)")),
    "retrieval_cascade": (retrieval_cascade, RETRIEVAL_CASCADE), "hit_dedupe": (hit_dedupe, HIT_DEDUPE), "index_validation": (index_validation, INDEX_VALIDATION),
    "resume_anti_join": (resume_anti_join, "SELECT vec_id, label FROM embeddings WHERE label % 2 <> 0"), "intake_session_summary": (intake_session_summary, INTAKE),
}
