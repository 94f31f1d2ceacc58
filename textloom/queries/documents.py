"""Queries over documents and pages: name -> (function, SQL or None)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import measures as M
from textloom.functions import text as X
from textloom.operators import dedupe, lines, segment
from textloom.queries import chunk_sql
from textloom.sources import pages as P
from textloom.sources import sinks
from textloom.sources.scratch import bounded_batches

#: The rules table of the test corpus: a lexicon family for each role. A real corpus brings its own.
LEXICON = {
    "theory": ["tion", "ment", "keit"],
    "test": ["!!"],
    "quest": ["@", "[0-9]{3}"],
    "exer": [" [|] "],
    "bib": ["License", "Copyright"],
    "tocw": ["[*]{3}"],
    "chap": ["[#]{3}"],
    "article": ["The ", "Die "],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores, if its files have fewer splits than there are cores; larger tables stay where they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id").withColumn("text", F.coalesce("text", F.lit("")))


def r6(c: Column) -> Column:
    return F.round(c, 6)


def n(pattern: str, t: str = "text") -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))"


def family(name: str, t: str = "text") -> str:
    return "(" + " + ".join(n(p, t) for p in LEXICON[name]) + ")"


DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents)"
LINES = "l AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d))"


def doc_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.md5(X.clean_spaces(t)).alias("clean"), F.md5(X.tidy(t)).alias("tidy"), F.md5(X.hash_key(t)).alias("hash_key"), F.md5(X.letter_key(t)).alias("letter_key"), X.preview(t).alias("preview"), X.plain(X.preview(t, 80)).alias("plain"), X.shorten(t, 200).alias("short"))


DOC_NORMALIZE = f"""WITH {DOCS}, a AS (
  SELECT doc_id, text, regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[﻿­​]', '', 'g'), ' ', ' '), '[ \\t]+', ' ', 'g'), '\\n{{4,}}', repeat(chr(10), 3), 'g') AS c,
    trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM d)
SELECT doc_id, md5(regexp_replace(c, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')) AS clean,
  md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' *\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ')) AS tidy,
  md5(trim(lower(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS hash_key,
  md5(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\s]+', '', 'g'), '\\s+', ' ', 'g'), ' ')) AS letter_key,
  substr(s, 1, 360) AS preview, trim(translate(substr(s, 1, 80), '*_', ''), ' ') AS plain,
  CASE WHEN length(text) > 200 THEN rtrim(substr(text, 1, 200), ' ') || '...' ELSE text END AS short FROM a"""


def doc_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    kept, dropped = X.drop_page_markers(t)
    return docs(spark, sf_dir).select("doc_id", F.md5(X.clean_artifacts(t)).alias("artifacts"), F.md5(X.join_hyphens(t)).alias("joined"), F.md5(kept).alias("unmarked"), dropped.cast("long").alias("markers"), X.cut_at_sentence(t).alias("cut"))


DOC_REPAIR = f"""WITH {DOCS}, m AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls,
    list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '(?i)^\\s*(?:\\d{{1,4}}|[ivxlcdm]{{1,8}}|=+\\s*page\\s+\\d+\\s*/\\s*\\d+\\s*=+|(?:page|стр\\.?|страница)\\s*\\d+)\\s*$')) AS kept, substr(text, 1, 1021) AS head FROM d)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[~|]{{3,}}|_{{4,}}', ' ', 'g'), '\\.{{5,}}', ' ... ', 'g'), '[ \\t]+([,.;:!?])', '\\1', 'g'), '\\s{{2,}}', ' ', 'g'), ' ')) AS artifacts,
  md5(regexp_replace(text, '(\\p{{L}})-\\n(\\p{{L}})', '\\1\\2', 'g')) AS joined, md5(array_to_string(kept, chr(10))) AS unmarked, CAST(len(ls) - len(kept) AS BIGINT) AS markers,
  CASE WHEN length(text) <= 1024 THEN text WHEN strpos(head, '.') > 0 AND length(head) - strpos(reverse(head), '.') > 500 THEN substr(text, 1, length(head) - strpos(reverse(head), '.') + 1) ELSE head || '...' END AS cut FROM m"""


def doc_line_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.clean_lines(docs(spark, sf_dir))
    return out.select("doc_id", F.md5("cleaned").alias("cleaned"), "navigation", "repeated", "empty")


NAV = r"(?i)^\s*(?:\d+|page\s+\d+(?:\s+of\s+\d+)?|стр\.?\s*\d+|страница\s+\d+|оглавление|содержание|www\.\S+|https?://\S+)\s*$|^\s*(?:copyright|all rights reserved)(?:[^\p{L}\p{N}_]|$)"
DOC_LINE_CLEAN = f"""WITH {DOCS}, l AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, regexp_replace(unnest(ls), '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g') AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d)), k AS (
  SELECT *, trim(lower(regexp_replace(line, '\\s+', ' ', 'g')), ' ') AS k, regexp_matches(line, '{NAV}') AS nav FROM l
), a AS (SELECT *, k <> '' AND NOT nav AND row_number() OVER (PARTITION BY doc_id, k, nav ORDER BY pos) > 1 AS again FROM k),
b AS (SELECT doc_id, pos, line, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM a WHERE NOT nav AND NOT again),
c AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS cleaned FROM b WHERE line <> '' OR before IS DISTINCT FROM '' GROUP BY doc_id)
SELECT doc_id, md5(coalesce(any_value(cleaned), '')) AS cleaned,
  count(*) FILTER (WHERE nav) AS navigation, count(*) FILTER (WHERE again) AS repeated, count(*) FILTER (WHERE k = '') AS empty FROM a LEFT JOIN c USING (doc_id) GROUP BY doc_id"""


def doc_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM-08, AGG-09 for sources: lines that documents of one source repeat."""
    return lines.repeated_lines(docs(spark, sf_dir).withColumn("source", F.coalesce("source", F.lit(""))), key="source")


DOC_REPEATED_LINES = f"""WITH {DOCS}, t AS (SELECT coalesce(source, '') AS source, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM d)
SELECT source, line, count(*) AS n FROM t WHERE length(line) BETWEEN 5 AND 120 AND line NOT LIKE '%.' AND len(list_distinct(regexp_split_to_array(lower(line), '\\s+'))) >= 2
GROUP BY source, line HAVING count(*) >= 4"""


def doc_token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", M.tokens_by_words(t).alias("by_words"), M.tokens_by_chars(t).alias("by_chars"), M.embedding_cost(M.tokens_by_chars(t)).alias("cost"))


DOC_TOKEN_ESTIMATES = f"""WITH {DOCS} SELECT doc_id, CAST(greatest(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')), round_even(greatest(length(text), 1) / 4.2::DOUBLE, 0)) AS BIGINT) AS by_words,
  CAST(ceil(length(text) / 4.0::DOUBLE) AS BIGINT) AS by_chars, round(ceil(length(text) / 4.0::DOUBLE) / 1e6::DOUBLE * 0.02::DOUBLE, 8) AS cost FROM d"""


def doc_script_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).withColumn("script", M.script_language(F.col("text"))).groupBy("lang", "script").agg(F.count("*").alias("n"))


DOC_SCRIPT_LANGUAGE = f"""WITH {DOCS}, c AS (SELECT lang, len(regexp_extract_all(substr(text, 1, 20000), '[А-Яа-яЁё]')) AS cyr, len(regexp_extract_all(substr(text, 1, 20000), '[A-Za-z]')) AS lat FROM d)
SELECT lang, CASE WHEN cyr < 20 AND lat < 20 THEN 'unknown' WHEN cyr > 2 * lat THEN 'ru' WHEN lat > 2 * cyr THEN 'en' ELSE 'mixed' END AS script, count(*) AS n FROM c GROUP BY 1, 2"""

FAMILIES = {"tests": ["!!"], "questionnaires": ["@"], "forms": ["[*]{3}"], "checklists": [" [|] "]}


def doc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, size = F.col("text"), F.length("text")
    out = docs(spark, sf_dir).select("doc_id", "text", M.intake_signals(t).alias("intake"), M.cleaner_signals(t, FAMILIES).alias("cleaner"))
    out = out.withColumn("score", M.cleaner_score(t, F.col("cleaner"))).withColumn("intake_score", M.intake_score(size, F.col("intake")))
    action = M.intake_action(M.extraction_status(F.lit("text"), F.lit("txt"), t), F.col("intake_score"), F.lit("low"))
    return out.select("doc_id", F.array_join("intake", ",").alias("intake"), F.array_join("cleaner", ",").alias("cleaner"), r6(F.col("intake_score")).alias("intake_score"), F.col("score").cast("long").alias("score"), M.quality_label(F.col("score"), F.col("cleaner")).alias("label"), action.alias("action"))


DOC_QUALITY = f"""WITH {DOCS}, m AS (
  SELECT doc_id, text, length(text) AS n, {n('�')} AS repl, {n(M.MOJIBAKE)} AS moji, {n('[РС][' + chr(0x400) + '-' + chr(0x4FF) + 'A-Za-z]{2,}')} AS cmoji, {n(M.MOJIBAKE_MARKS)} AS marks, {n('[ \\t\\n\\r\\f\\v]')} AS ws, {n('[A-Za-zА-Яа-яЁё]')} AS al, {n('[А-Яа-яЁё]')} AS cyr,
    len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: length(w) > 45)) AS long_words,
    {n('[._' + chr(92) + '-–—=]{6,}')} AS runs, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')) AS ks FROM d
), s AS (
  SELECT doc_id, text, n, CASE WHEN n = 0 THEN ['empty_text'] ELSE list_filter([CASE WHEN repl > 5 THEN 'replacement_characters' END, CASE WHEN moji > 30 THEN 'possible_mojibake' END, CASE WHEN ws / n > 0.45 THEN 'excessive_whitespace' END,
      CASE WHEN al / n < 0.35 THEN 'low_alpha_ratio' END, CASE WHEN long_words > 5 THEN 'many_overlong_tokens' END, CASE WHEN n < 300 THEN 'very_short_text' END], lambda x: x IS NOT NULL) END AS a,
    list_filter([CASE WHEN n < 300 THEN 'ultra_short_fragments' END, CASE WHEN n > 0 AND al / greatest(n, 1) < 0.35 THEN 'low_semantic_density' END,
      CASE WHEN cmoji > 15 OR marks > 40 OR (cmoji > 6 AND cyr / greatest(al, 1) > 0.5) THEN 'corrupted_ocr_or_mojibake' END, CASE WHEN repl > 5 THEN 'broken_symbols' END, CASE WHEN runs > 3 THEN 'repeated_patterns' END,
      CASE WHEN len(ks) - len(list_distinct(ks)) > 5 THEN 'repeated_lines' END, CASE WHEN contains(text, '!!') THEN 'tests' END, CASE WHEN contains(text, '@') THEN 'questionnaires' END,
      CASE WHEN contains(text, '***') THEN 'forms' END, CASE WHEN contains(text, ' | ') THEN 'checklists' END], lambda x: x IS NOT NULL) AS b FROM m
), q AS (
  SELECT *, len(list_filter(b, lambda x: x IN ('low_semantic_density', 'corrupted_ocr_or_mojibake'))) AS severe,
    round(greatest(0, least(1, 1.0::DOUBLE - CASE WHEN n < 1000 THEN 0.25 ELSE 0 END - CASE WHEN n < 300 THEN 0.25 ELSE 0 END - 0.12::DOUBLE * len(a))), 2) AS intake_score FROM s
), w AS (SELECT *, CASE WHEN regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g') = '' THEN 0 ELSE 1 END * greatest(0, 100 - CASE WHEN n < 1000 THEN 15 ELSE 0 END - CASE WHEN n < 300 THEN 35 ELSE 0 END - 35 * severe - 12 * (len(b) - severe)) AS score FROM q)
SELECT doc_id, array_to_string(a, ',') AS intake, array_to_string(b, ',') AS cleaner, intake_score, CAST(score AS BIGINT) AS score,
  CASE WHEN score < 35 OR list_contains(b, 'corrupted_ocr_or_mojibake') THEN 'REJECT' WHEN score < 55 THEN 'LOW' WHEN score < 80 THEN 'MEDIUM' ELSE 'HIGH' END AS label,
  CASE WHEN intake_score >= 0.65 THEN 'ready_for_cleaning' ELSE 'needs_review' END AS action FROM w"""


def doc_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    d = dedupe.exact_duplicates(docs(spark, sf_dir), F.sha2("text", 256))
    d = d.select("doc_id", F.length("text").alias("chars"), F.col("duplicate_of").isNotNull().alias("duplicate"), M.document_noise(t).alias("noise"), F.regexp_count(t, F.lit("(?m)" + M.NUMBERED)).alias("numbered"), *[M.hits(t, p).alias(k) for k, p in LEXICON.items()])
    d = d.withColumn("bibd", F.col("bib") / F.greatest(F.col("chars") / 10_000, F.lit(1.0)))
    c = M.category_ladder({k: F.col(k) for k in d.columns})
    return d.select("doc_id", c.alias("c")).select("doc_id", "c.category", r6(F.col("c.confidence")).alias("confidence"))


DOC_CATEGORY = f"""WITH {DOCS}, m AS (
  SELECT doc_id, length(text) AS chars, doc_id <> min(doc_id) OVER (PARTITION BY text) AS duplicate, substr(text, 1, 50000) AS t, {n('(?m)^\\s*(?:\\d{1,3}[).:]|[a-zA-Zа-яА-Я][).:])\\s+\\S+')} AS numbered,
    {', '.join(f'{family(k)} AS {k}' for k in LEXICON)} FROM d
), z AS (
  SELECT *, bib / greatest(chars / 10000.0::DOUBLE, 1) AS bibd, list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ') <> '') AS ls FROM m
), x AS (
  SELECT *, (1 - {n('[A-Za-zА-Яа-яЁё]', 't')} / greatest(length(t), 1)) * 0.6::DOUBLE + len(list_filter(ls, lambda x: length(trim(x, ' ')) <= 3)) / greatest(len(ls), 1) * 0.4::DOUBLE + least(0.4::DOUBLE, {n('�', 't')} / greatest(length(t), 1) * 10) AS noise FROM z
), c AS (SELECT *, CASE WHEN duplicate THEN 'duplicate' WHEN chars > 2000 AND noise >= 0.56 AND theory < 5 THEN 'ocr_noise' WHEN bib >= 8 AND (chars < 25000 OR bibd >= 7 OR theory < 8) THEN 'bibliography'
  WHEN quest >= 2 OR (quest >= 1 AND numbered >= 8) THEN 'questionnaire' WHEN test >= 4 OR (test >= 2 AND numbered >= 10) THEN 'test' WHEN exer >= 4 OR (exer >= 2 AND numbered >= 6) THEN 'exercise'
  WHEN chars >= 8000 AND theory >= 8 THEN 'good_source' WHEN chars >= 1500 AND (article >= 1 OR theory >= 4) THEN 'article' ELSE 'unclear' END AS category FROM x)
SELECT doc_id, category, round(CASE category WHEN 'duplicate' THEN 0.98::DOUBLE WHEN 'ocr_noise' THEN 0.75::DOUBLE + least(noise - 0.56::DOUBLE, 0.2) WHEN 'bibliography' THEN least(0.95, 0.65::DOUBLE + bib / 100) WHEN 'questionnaire' THEN least(0.96::DOUBLE, 0.66::DOUBLE + quest / 30 + least(numbered, 30) / 100)
  WHEN 'test' THEN least(0.95::DOUBLE, 0.62::DOUBLE + test / 40 + least(numbered, 40) / 120) WHEN 'exercise' THEN least(0.9::DOUBLE, 0.6::DOUBLE + exer / 40) WHEN 'good_source' THEN least(0.9::DOUBLE, 0.62::DOUBLE + theory / 100)
  WHEN 'article' THEN least(0.84::DOUBLE, 0.58::DOUBLE + (article + theory) / 80) ELSE 0.5::DOUBLE END, 6) AS confidence FROM c"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-06 for each line, as a block; keys are counted within the document's row, so lines are never shuffled."""
    t = F.col("text")
    own = docs(spark, sf_dir).select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("lines"))
    keys = F.filter(F.transform("lines", lambda x: X.hash_key(x)), lambda k: F.length(k).between(40, 600))
    own = own.withColumn("keys", F.array_sort(F.transform(keys, lambda k: F.xxhash64(k))))
    often = F.array_distinct(F.filter("keys", lambda k, i: F.coalesce(F.get("keys", i + 3) == k, F.lit(False))))  # met four times or more
    b = own.withColumn("often", often).select("doc_id", "often", F.posexplode("lines").alias("pos", "text"))
    dup = F.when((F.size("often") > 0) & F.array_contains("often", F.xxhash64(X.hash_key(t))), 4).otherwise(0)
    m = b.select("doc_id", "pos", dup.alias("dup"), F.length(t).alias("chars"), M.theory_score(t, LEXICON["theory"]).alias("theory"), M.block_noise(t).alias("noise"), M.line_share(t, M.NUMBERED).alias("num"), M.line_share(t, M.CONTENTS).alias("toc"), M.line_share(t, M.REFERENCE).alias("ref"), *[M.hits(t, LEXICON[k]).alias(k) for k in ("bib", "quest", "test", "exer", "tocw", "chap")], t.contains("%").alias("scoring"), t.contains("$").alias("instr"), t.contains("&").alias("clinical"))
    return m.select("doc_id", "pos", "chars", M.block_ladder({c: F.col(c) for c in m.columns}).alias("b")).select("doc_id", "pos", "chars", "b.*")


def block_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-06 with AGG-01/02/03 per document: label counts and the char-weighted mean confidence."""
    w = F.greatest("chars", F.lit(1))
    return blocks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("action") == "reject").alias("rejected"), F.count_if(F.col("label") == "review_unclear").alias("unclear"), r6(F.sum(F.col("confidence") * w) / F.sum(w)).alias("confidence"), F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"))


BLOCK_CLASSIFY = f"""WITH {DOCS}, {LINES}, b AS (SELECT doc_id, pos, line AS text, length(line) AS chars, trim(lower(regexp_replace(line, '\\s+', ' ', 'g')), ' ') AS k FROM l WHERE trim(line, ' ') <> ''
), c AS (
  SELECT *, CASE WHEN length(k) BETWEEN 40 AND 600 THEN count(*) OVER (PARTITION BY doc_id, k) ELSE 0 END AS dup, substr(text, 1, 4000) AS t, chars / greatest({n('[.!?]+')}, 1) AS av, {family('theory')} AS th,
    CASE WHEN regexp_matches(text, '^\\s*(?:\\d{{1,3}}[).:]|[a-zA-Zа-яА-Я][).:])\\s+\\S+') THEN 1 ELSE 0 END AS num, CASE WHEN regexp_matches(text, '.{{3,120}}\\s+\\.{{2,}}\\s*\\d{{1,4}}\\s*$') THEN 1 ELSE 0 END AS toc,
    CASE WHEN regexp_matches(text, '(?:^|[^0-9A-Za-z_])(?:19|20)\\d{{2}}(?:[^0-9A-Za-z_].*)?[.,].{{8,}}') THEN 1 ELSE 0 END AS ref,
    {', '.join(f'{family(k)} AS {k}' for k in ('bib', 'quest', 'test', 'exer', 'tocw', 'chap'))}, contains(text, '%') AS scoring, contains(text, '$') AS instr, contains(text, '&') AS clinical FROM b
), e AS (
  SELECT *, least(1.0::DOUBLE, th * 1000.0::DOUBLE / chars / 4 + CASE WHEN av BETWEEN 55 AND 260 THEN 0.12::DOUBLE ELSE 0 END) AS theory,
    least(1.0::DOUBLE, (1 - {n('\\p{L}', 't')} / greatest(length(t), 1)) * 0.65::DOUBLE + {n('�', 't')} * 0.02::DOUBLE + {n('[^\\p{L}\\p{N}\\s.,;:!?()\\-]{4,}', 't')} * 0.03::DOUBLE) AS noise FROM c
), f AS (
  SELECT doc_id, chars, CASE WHEN dup >= 4 AND theory < 0.35 THEN 'reject_duplicate_paragraph' WHEN noise >= 0.72 AND chars < 1200 AND theory < 0.25 THEN 'reject_ocr_noise' WHEN (tocw >= 1 AND toc >= 0.25) OR toc >= 0.45 OR (chap >= 3 AND chars < 3500) THEN 'reject_toc'
    WHEN bib >= 2 AND (ref >= 0.35 OR bib * 1000 >= 5 * chars) AND theory < 0.45 THEN 'reject_bibliography' WHEN quest >= 2 AND num >= 0.22 AND theory < 0.5 THEN 'reject_questionnaire' WHEN test >= 4 AND num >= 0.2 AND theory < 0.5 THEN 'reject_test'
    WHEN scoring AND (num >= 0.12 OR quest >= 1 OR test >= 4) AND theory < 0.45 THEN 'reject_scoring_key' WHEN exer >= 3 AND num >= 0.12 AND instr AND NOT clinical AND theory < 0.5 THEN 'reject_exercise'
    WHEN theory >= 0.55 THEN 'keep_theory' WHEN theory >= 0.35 AND chars >= 450 THEN 'keep_clinical' WHEN chars >= 650 AND num < 0.25 AND noise < 0.6 THEN 'keep_narrative' ELSE 'review_unclear' END AS label FROM e
), g AS (SELECT *, CASE label WHEN 'reject_duplicate_paragraph' THEN 0.86 WHEN 'reject_ocr_noise' THEN 0.82 WHEN 'reject_toc' THEN 0.88 WHEN 'reject_bibliography' THEN 0.86 WHEN 'reject_questionnaire' THEN 0.84 WHEN 'reject_test' THEN 0.83 WHEN 'reject_scoring_key' THEN 0.80
    WHEN 'reject_exercise' THEN 0.78 WHEN 'keep_theory' THEN 0.82 WHEN 'keep_clinical' THEN 0.72 WHEN 'keep_narrative' THEN 0.68 ELSE 0.56 END::DOUBLE AS confidence FROM f)
SELECT doc_id, count(*) AS blocks, count(*) FILTER (WHERE label LIKE 'reject%') AS rejected, count(*) FILTER (WHERE label = 'review_unclear') AS unclear, round(sum(confidence * chars) / sum(chars), 6) AS confidence, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM g GROUP BY doc_id"""


def doc_exact_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.exact_duplicates(docs(spark, sf_dir).filter("text != ''"), F.sha2("text", 256)).filter("n_same > 1").select("doc_id", F.coalesce("duplicate_of", F.lit(-1)).alias("duplicate_of"), "n_same", F.sha2("text", 256).alias("sha256"))


DOC_EXACT_DUPES = f"""WITH {DOCS}, a AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS first, count(*) OVER (PARTITION BY text) AS n_same FROM d WHERE text <> '')
SELECT doc_id, CASE WHEN doc_id > first THEN first ELSE -1 END AS duplicate_of, n_same, sha256(text) AS sha256 FROM a WHERE n_same > 1"""


def doc_near_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-10 over all documents: shingles of five words, similarity 0.8; texts with links to others."""
    return dedupe.near_classes(docs(spark, sf_dir)).filter("n_links > 0")


DOC_NEAR_DUPES = f"""WITH RECURSIVE {DOCS}, w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) END)) AS g FROM w WHERE len(w) > 0),
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM g), p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k, any_value(a.n) AS x, any_value(b.n) AS y FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT u, v FROM p WHERE k / (x + y - k) >= 0.8), r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v)
SELECT u AS doc_id, min(v) AS class_id, (SELECT count(*) FROM l WHERE l.u = r.u) AS n_links FROM r GROUP BY u"""


def chunk_word_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = segment.word_windows(docs(spark, sf_dir).select("doc_id", "source", "text"))
    key = F.concat_ws(":", "source", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"), F.sha1(X.hash_key(F.col("chunk"))))
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("n_words").cast("long").alias("n_words"), F.sha1(key).alias("chunk_id"))


DOC_WORDS = "w AS (SELECT doc_id, source, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM d)"
CHUNKS = f"c AS (SELECT doc_id, source, unnest(range(0, CAST(ceil(len(ws) / 450.0) AS BIGINT))) AS i, ws FROM w), k AS (SELECT doc_id, source, i, ws[i * 450 + 1 : i * 450 + 500] AS p FROM c)"
CHUNK_WORD_WINDOW = f"""WITH {DOCS}, {DOC_WORDS}, {CHUNKS}
SELECT doc_id, i AS chunk_index, CAST(len(p) AS BIGINT) AS n_words, sha1(source || ':' || doc_id || ':' || i || ':' || sha1(trim(lower(regexp_replace(array_to_string(p, ' '), '\\s+', ' ', 'g')), ' '))) AS chunk_id FROM k"""


def chunk_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MSR-22, FLT-18, AGG-24 over word windows."""
    c = segment.word_windows(docs(spark, sf_dir).select("source", "text")).withColumn("x", M.diagnostics(F.col("chunk")))
    return c.groupBy("source").agg(F.count("*").alias("chunks"), F.count_if("x.size").alias("bad_size"), F.count_if("x.ocr").alias("ocr"), F.count_if("x.encoding").alias("encoding"), r6(F.avg("x.latin")).alias("latin"))


CHUNK_DIAGNOSTICS = f"""WITH {DOCS}, {DOC_WORDS}, {CHUNKS}, t AS (SELECT source, array_to_string(p, ' ') AS t, len(p) AS words FROM k), m AS (
  SELECT source, words, length(t) AS n, {n('[А-Яа-яЁё]', 't')} AS cyr, {n('[A-Za-z]', 't')} AS lat, {n('�', 't')} AS repl, {n('(?:Р[а-яА-ЯЁёA-Z]?|С[а-яА-ЯЁёA-Z]?|вЂ|В«|В»|В©|В®)', 't')} AS moji,
    len(list_filter(regexp_extract_all(t, '[^\\p{{L}}\\p{{N}}\\s.,;:!?()"«»\\-—№%/]{{4,}}'), lambda x: NOT regexp_matches(x, '^=+$'))) AS runs, {n('\\d', 't')} AS dig, {n('===== PAGE \\d+ / \\d+ =====', 't')} AS pg FROM t)
SELECT source, count(*) AS chunks, count(*) FILTER (WHERE words < 80 OR words > 650) AS bad_size, count(*) FILTER (WHERE runs > 0 OR dig / n > 0.18 OR pg > 4) AS ocr,
  count(*) FILTER (WHERE repl > 0 OR moji > 10 OR cyr / greatest(cyr + lat, 1) < 0.35) AS encoding, round(avg(lat / greatest(cyr + lat, 1)), 6) AS latin FROM m GROUP BY source"""


def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06, AGG-07: one row; means of the documents' means."""
    c = segment.word_windows(docs(spark, sf_dir).select("doc_id", "text")).withColumn("tokens", M.tokens_by_chars(F.col("chunk")))
    by = c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.avg("tokens").alias("mean"), F.max("tokens").alias("most"))
    return by.agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"), r6(F.avg("mean")).alias("mean_of_means"), F.max("most").alias("most"))


CORPUS_MANIFEST = f"""WITH {DOCS}, {DOC_WORDS}, {CHUNKS}, t AS (SELECT doc_id, CAST(ceil(length(array_to_string(p, ' ')) / 4.0::DOUBLE) AS BIGINT) AS tokens FROM k),
b AS (SELECT doc_id, count(*) AS chunks, avg(tokens) AS mean, max(tokens) AS most FROM t GROUP BY doc_id)
SELECT count(*) AS documents, CAST(sum(chunks) AS BIGINT) AS chunks, round(avg(mean), 6) AS mean_of_means, max(most) AS most FROM b"""


def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.semantic_chunks(docs(spark, sf_dir).select("doc_id", "text"), separator="\n")


CHUNK_SEMANTIC = f"""WITH RECURSIVE {DOCS}, {chunk_sql.semantic('d', 'doc_id', chr(92) + 'n')}
SELECT k AS doc_id, chunk_index::INTEGER AS chunk_index, chunk, first_paragraph, last_paragraph, tokens, continuity, redundancy FROM chunks"""


def chunk_token_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = segment.token_chunks(docs(spark, sf_dir).select("doc_id", "text"), separator="\n")
    return dedupe.previous_duplicates(c.withColumn("seq", F.col("doc_id") * 100_000 + F.col("chunk_index")), F.sha1(X.hash_key(F.col("chunk"))), "seq", 1000 * 100_000).select("doc_id", "chunk_index", "parts", "n_same", F.coalesce("duplicate_of", F.lit(-1)).alias("duplicate_of"), F.sha1("chunk").alias("sha1"))


def chunk_paragraph_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.word_chunks(docs(spark, sf_dir).select("doc_id", "text"), separator="\n").select("doc_id", "chunk_index", F.sha1("chunk").alias("sha1"))


def publish_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", F.concat(F.lit("sorted/"), "lang").alias("target"), F.concat("source", F.lit(".txt")).alias("filename"))
    return sinks.copy_plan(d, "target", "filename", "doc_id").select("doc_id", "target", "target_name", "status")


PUBLISH_PLAN = """WITH a AS (SELECT doc_id, 'sorted/' || lang AS target, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents)
SELECT doc_id, target, source || CASE WHEN n = 1 THEN '' ELSE '__' || (n - 1) END || '.txt' AS target_name, CASE WHEN n = 1 THEN 'planned' ELSE 'renamed' END AS status FROM a"""


def publish_plan_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-10, SNK-11 in the order of paths."""
    path = F.concat_ws("/", F.lit("in"), F.coalesce("lang", F.lit("-")), F.col("doc_id").cast("string"))
    d = docs(spark, sf_dir).select(path.alias("path"), F.lit("sorted").alias("target"), F.concat(F.coalesce("source", F.lit("-")), F.lit(".txt")).alias("filename"))
    return sinks.copy_plan(d, "target", "filename", "path").select("path", "target_name", "status")


PUBLISH_PLAN_BY_PATH = """WITH p AS (SELECT 'in/' || coalesce(lang, '-') || '/' || doc_id AS path, coalesce(source, '-') AS source FROM documents), a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY path) AS n FROM p)
SELECT path, source || CASE WHEN n = 1 THEN '' ELSE '__' || (n - 1) END || '.txt' AS target_name, CASE WHEN n = 1 THEN 'planned' ELSE 'renamed' END AS status FROM a"""


def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.dense_ids(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", F.col("vector_id").cast("long").alias("vector_id"))


DENSE_IDS = "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS vector_id FROM documents"


def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.articles(spread(table(spark, sf_dir, "pages"), "page_id")).select("page_id", "title", F.md5("text").alias("text"), F.coalesce("error", F.lit("")).alias("error"))


TAGS = "trim(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"
# the given pages have no container within another, so a pattern finds each one's end
CONTAINERS = r'(?is)<article\b[^>]*>(.*?)</article>|<(?:div|section|main)\b[^>]*class="(?:[^"]*\s)?(?:article_text|text|content)(?:\s[^"]*)?"[^>]*>(.*?)</(?:div|section|main)>'
PAGE_EXTRACT = f"""WITH a AS (SELECT page_id, {TAGS.format("regexp_extract(coalesce(html, ''), '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS title, {TAGS.format("array_to_string(regexp_extract_all(coalesce(html, ''), '" + CONTAINERS + "'), ' ')")} AS t FROM pages)
SELECT page_id, title, md5(t) AS text, CASE WHEN title = '' THEN 'no_title' WHEN t = '' THEN 'no_text' ELSE '' END AS error FROM a"""


def page_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-02 for pages within a content container: the whole page's text, then that of its own containers."""
    whole = F.concat(F.lit('<div class="content wide"><div>'), F.coalesce("html", F.lit("")), F.lit("</div></div>"))
    return bounded_batches(spread(table(spark, sf_dir, "pages"), "page_id")).select("page_id", F.md5(P.main_text(whole)).alias("text"))


PAGE_NESTED = f"""WITH a AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g') AS said FROM pages)
SELECT page_id, md5(trim(regexp_replace({TAGS.format('said')} || ' ' || {TAGS.format("array_to_string(regexp_extract_all(html, '" + CONTAINERS + "'), ' ')")}, '\\s+', ' ', 'g'), ' ')) AS text FROM a"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.links(table(spark, sf_dir, "pages"))


PAGE_LINKS = """SELECT page_id, 'https://example.org' || h AS link FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)<a[^>]+href="([^"]*)"', 1)) AS h FROM pages) WHERE h LIKE '/%'"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, grade and chunk documents; one row for each quality label."""
    d = docs(spark, sf_dir).select("doc_id", "source", X.clean_spaces(F.col("text")).alias("text"))
    s = d.select("*", M.cleaner_signals(F.col("text"), FAMILIES).alias("s")).withColumn("score", M.cleaner_score(F.col("text"), F.col("s"))).withColumn("label", M.quality_label(F.col("score"), F.col("s")))
    c = segment.word_windows(s.select("doc_id", "label", "score", "text"))
    return c.groupBy("label").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.sum(M.tokens_by_chars(F.col("chunk"))).alias("tokens"), r6(F.avg("score")).alias("score"))


#: White space as Python's str and re see it.
WIDE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PARTS = f"ps AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: regexp_replace(p, '^{WIDE}+|{WIDE}+$', '', 'g')), lambda p: p <> '') AS ps FROM d)"

CHUNK_TOKEN_PACKED = f"""WITH RECURSIVE {DOCS}, {PARTS}, q AS (SELECT doc_id, list_transform(ps, lambda p: regexp_replace(p, '{WIDE}+', ' ', 'g')) AS ps FROM ps WHERE len(ps) > 0),
r AS (SELECT doc_id, ps, 0 AS i, CAST([] AS VARCHAR[]) AS own, CAST(NULL AS VARCHAR[]) AS full_pack FROM q
  UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN over THEN own[len(own) - fit + 1 :] ELSE own END || [ps[i + 1]], CASE WHEN over THEN own END
  FROM (SELECT *, len(own) > 0 AND coalesce(list_sum(list_transform(own, lambda x: ceil(length(x) / 4.0::DOUBLE))), 0) + ceil(length(ps[i + 1]) / 4.0::DOUBLE) > 700 AS over, len(list_filter(range(1, len(own) + 1), lambda j: list_sum(list_transform(own[j:], lambda x: ceil(length(x) / 4.0::DOUBLE))) <= 80)) AS fit FROM r WHERE i < len(ps))),
c AS (SELECT doc_id, i, full_pack AS g FROM r WHERE full_pack IS NOT NULL UNION ALL SELECT doc_id, i + 1, own FROM r WHERE i = len(ps)),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, g, array_to_string(g, chr(10) || chr(10)) AS chunk FROM c), h AS (SELECT *, doc_id * 100000 + chunk_index AS seq, sha1(trim(lower(regexp_replace(chunk, '\\s+', ' ', 'g')), ' ')) AS k FROM n)
SELECT doc_id, chunk_index, len(g) AS parts, count(*) OVER (PARTITION BY k) AS n_same, coalesce(lag(seq) OVER (PARTITION BY k ORDER BY seq), -1) AS duplicate_of, sha1(chunk) AS sha1 FROM h"""

CHUNK_PARAGRAPH_WORDS = f"""WITH RECURSIVE {DOCS}, {PARTS}, q AS (SELECT doc_id, ps, list_transform(ps, lambda p: list_filter(regexp_split_to_array(p, '{WIDE}+'), lambda x: x <> '')) AS ws FROM ps WHERE len(ps) > 0),
r AS (SELECT doc_id, ps, ws, 0 AS i, CAST([] AS VARCHAR[]) AS own, CAST(0 AS BIGINT) AS have, CAST([] AS VARCHAR[]) AS done FROM q
  UNION ALL SELECT doc_id, ps, ws, i + 1, CASE WHEN long THEN [] WHEN over THEN [lead, ps[i + 1]] ELSE own || [ps[i + 1]] END, CASE WHEN long THEN 0 WHEN over THEN least(70, have) + len(w) ELSE have + len(w) END,
    CASE WHEN long THEN CASE WHEN len(own) > 0 THEN [array_to_string(own, chr(10) || chr(10))] ELSE [] END || list_transform(range(0, len(w), 350), lambda k: array_to_string(w[k + 1 : k + 420], ' ')) WHEN over THEN [array_to_string(own, chr(10) || chr(10))] ELSE [] END
  FROM (SELECT *, ws[i + 1] AS w, len(ws[i + 1]) > 420 AS long, len(own) > 0 AND have + len(ws[i + 1]) > 420 AS over, array_to_string(list_filter(regexp_split_to_array(array_to_string(own, ' '), '{WIDE}+'), lambda x: x <> '')[-70:], ' ') AS lead FROM r WHERE i < len(ps))),
c AS (SELECT doc_id, i, unnest(done) AS chunk, generate_subscripts(done, 1) AS k FROM r UNION ALL SELECT doc_id, i + 1, array_to_string(own, chr(10) || chr(10)), 1 FROM r WHERE i = len(ps) AND len(own) > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS chunk_index, sha1(chunk) AS sha1 FROM c"""

_CLEAN = """d AS (SELECT doc_id, source, regexp_replace(c, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g') AS text FROM (SELECT doc_id, source, regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '[' || chr(65279) || chr(173) || chr(8203) || ']', '', 'g'), chr(160), ' '), '[ \\t]+', ' ', 'g'), '\\n{4,}', repeat(chr(10), 3), 'g') AS c FROM documents))"""
QUALITY_SUMMARY = f"""{DOC_QUALITY.rsplit(chr(10) + 'SELECT', 1)[0].replace(DOCS, _CLEAN)}, y AS (SELECT doc_id, score, CASE WHEN score < 35 OR list_contains(b, 'corrupted_ocr_or_mojibake') THEN 'REJECT' WHEN score < 55 THEN 'LOW' WHEN score < 80 THEN 'MEDIUM' ELSE 'HIGH' END AS label, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM w),
z AS (SELECT doc_id, score, label, unnest(range(0, CAST(ceil(len(ws) / 450.0) AS BIGINT))) AS i, ws FROM y)
SELECT label, count(DISTINCT doc_id) AS documents, count(*) AS chunks, CAST(sum(ceil(length(array_to_string(ws[i * 450 + 1 : i * 450 + 500], ' ')) / 4.0::DOUBLE)) AS BIGINT) AS tokens, round(avg(score), 6) AS score FROM z GROUP BY label"""

QUERIES = {
    "doc_normalize": (doc_normalize, DOC_NORMALIZE), "doc_repair": (doc_repair, DOC_REPAIR), "doc_line_clean": (doc_line_clean, DOC_LINE_CLEAN), "doc_repeated_lines": (doc_repeated_lines, DOC_REPEATED_LINES),
    "doc_token_estimates": (doc_token_estimates, DOC_TOKEN_ESTIMATES), "doc_script_language": (doc_script_language, DOC_SCRIPT_LANGUAGE), "doc_quality": (doc_quality, DOC_QUALITY), "doc_category": (doc_category, DOC_CATEGORY),
    "block_classify": (block_classify, BLOCK_CLASSIFY), "doc_exact_dupes": (doc_exact_dupes, DOC_EXACT_DUPES), "doc_near_dupes": (doc_near_dupes, DOC_NEAR_DUPES), "chunk_word_window": (chunk_word_window, CHUNK_WORD_WINDOW),
    "chunk_diagnostics": (chunk_diagnostics, CHUNK_DIAGNOSTICS), "corpus_manifest": (corpus_manifest, CORPUS_MANIFEST), "chunk_semantic": (chunk_semantic, CHUNK_SEMANTIC), "chunk_token_packed": (chunk_token_packed, CHUNK_TOKEN_PACKED),
    "chunk_paragraph_words": (chunk_paragraph_words, CHUNK_PARAGRAPH_WORDS), "page_nested": (page_nested, PAGE_NESTED), "publish_plan_by_path": (publish_plan_by_path, PUBLISH_PLAN_BY_PATH), "publish_plan": (publish_plan, PUBLISH_PLAN), "dense_ids": (dense_ids, DENSE_IDS), "page_extract": (page_extract, PAGE_EXTRACT), "page_links": (page_links, PAGE_LINKS), "quality_summary": (flagship, QUALITY_SUMMARY),
}
