"""Queries of the corpus jobs (cleaning, stabilisation, triage, ingestion, reports): name -> (function, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import measures as M
from textloom.functions import text as X
from textloom.operators import cleaning, dedupe, ingest, retrieve, segment, stabilize, triage, usage
from textloom.queries import retrieval
from textloom.queries.documents import BLOCK_CLASSIFY, CHUNKS, DOC_QUALITY, DOC_WORDS, DOCS, LEXICON, blocks, docs, n, r6, table
from textloom.queries import jobs_sql
from textloom.queries.usage import events
from textloom.sources import pages, sinks


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a paragraph for each line that ends with a full stop, and a name whose ending goes by the id."""
    ends = F.element_at(F.array(*map(F.lit, [".ocr.raw.cleaned.txt", ".cleaned.txt", ".pdf", ".doc", ".md"])), (F.col("doc_id") % 5 + 1).cast("int"))
    d = docs(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"\.\n", ".\n\n"))
    return d.select("doc_id", "source", "lang", "text", F.concat(F.lit("d"), F.md5(F.substring("text", 1, 40)), ends).alias("filename"))


NAMED = """d AS (SELECT doc_id, coalesce(source, '') AS source, lang, regexp_replace(coalesce(text, ''), '\\.\\n', '.' || chr(10) || chr(10), 'g') AS text FROM documents),
f AS (SELECT *, 'd' || md5(substr(text, 1, 40)) || ['.ocr.raw.cleaned.txt', '.cleaned.txt', '.pdf', '.doc', '.md'][doc_id % 5 + 1] AS filename FROM d)"""


def doc_text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM-09, NRM-14, NRM-18, NRM-19, NRM-21 second form."""
    t = F.col("text")
    return named(spark, sf_dir).select("doc_id", F.md5(X.word_key(t)).alias("word_key"), X.base_key(F.col("filename")).alias("base"), X.file_name(F.concat("source", F.lit(": a/b?"), "filename")).alias("name"), F.md5(X.cut_at_word(t, 300)).alias("cut"), F.md5(X.mend_lines(t)).alias("mended"))


DOC_TEXT_KEYS = f"""WITH {NAMED}, m AS (SELECT *, regexp_replace(regexp_replace(text, '[ \\t]*\\n[ \\t]*', chr(10), 'g'), '-\\n(\\p{{Ll}})', '\\1', 'g') AS h, substr(text, 1, 301) AS head FROM f),
o AS (SELECT *, regexp_replace(regexp_replace(h, '([^.!?;:)\\n])\\n(\\p{{Ll}})', '\\1 \\2', 'g'), '([^.!?;:)\\n])\\n(\\p{{Ll}})', '\\1 \\2', 'g') AS mended FROM m)
SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]+', ' ', 'g'), ' ')) AS word_key, regexp_replace(filename, '(\\.ocr\\.raw\\.cleaned\\.txt|\\.cleaned\\.txt|\\.[^.]*)$', '') AS base,
  substr(regexp_replace(source || ': a/b?' || filename, '[<>:"/\\\\|?*]', '_', 'g'), 1, 120) AS name,
  md5(CASE WHEN length(text) <= 300 THEN text WHEN strpos(head, '.') > 0 AND length(head) - strpos(reverse(head), '.') > 120 THEN substr(text, 1, length(head) - strpos(reverse(head), '.') + 1)
    WHEN strpos(head, ' ') > 0 THEN substr(text, 1, length(head) - strpos(reverse(head), ' ')) || '.' ELSE substr(text, 1, 300) || '.' END) AS cut, md5(mended) AS mended FROM o"""


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM-20, EXT-04: which pages have a URL, and what they say of themselves."""
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(X.is_url(F.col("url")), F.lit(False)).alias("is_url"), pages.description(F.coalesce("html", F.lit(""))).alias("description"))


PAGE_URLS = """SELECT page_id, coalesce(regexp_matches(trim(url, ' '), '(?i)^https?://\\S+$'), false) AS is_url, trim(regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<p\\b[^>]*>(.*?)</p>', 1), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), ' ') AS description FROM pages"""


def doc_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01, FLT-02, SEG-05, MSR-05, MSR-16, MSR-23, AGG-09."""
    t = F.col("text")
    d = named(spark, sf_dir).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).withColumn("stats", stabilize.paragraph_stats(t))
    count = lambda label: F.size(F.filter("lines", lambda x: M.paragraph_label(x) == label)).cast("long").alias(label)
    return d.select("doc_id", F.size(F.filter("lines", lambda x: M.is_heading(x))).cast("long").alias("headings"), count("list_like"), count("example_or_clinical"), F.size(segment.sentences(t)).cast("long").alias("sentences"), F.col("stats.paragraphs").cast("long").alias("paragraphs"), F.col("stats.longest").cast("long").alias("longest"), "stats.large", stabilize.source_quality(t, F.col("stats.large")).alias("quality"), r6(M.overlap(F.substring("text", 1, 1000), F.substring("text", 1001, 1000))).alias("overlap"))


DOC_STRUCTURE = f"""WITH {NAMED}, m AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS ls, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS ps,
  list_distinct(regexp_extract_all(lower(substr(text, 1, 1000)), '[A-Za-zА-Яа-яЁё]{{4,}}')) AS wa, list_distinct(regexp_extract_all(lower(substr(text, 1001, 1000)), '[A-Za-zА-Яа-яЁё]{{4,}}')) AS wb FROM f),
l AS (SELECT *, list_transform(ls, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS ts, list_transform(ls, lambda x: trim(x, ' ')) AS tt, len(ps) <= 2 AND length(text) > 10000 AS large FROM m)
SELECT doc_id, CAST(len(list_filter(ts, lambda x: length(x) BETWEEN 1 AND 140 AND (regexp_matches(x, '(?i)^(?:chapter|part|section|глава|часть|раздел)(?:[^\\p{{L}}\\p{{N}}_]|$)|^\\d{{1,2}}(?:\\.\\d{{1,2}}){{0,3}}\\.?\\s+\\S+') OR (x = upper(x) AND len(regexp_extract_all(x, '\\p{{L}}')) >= 4)))) AS BIGINT) AS headings,
  CAST(len(list_filter(tt, lambda x: NOT (length(x) <= 140 AND regexp_matches(x, '(?i)^(?:глава|раздел|часть|chapter|section)\\s+\\d+')) AND NOT (length(x) <= 120 AND x = upper(x) AND len(regexp_extract_all(x, '[A-Za-zА-Яа-яЁё]')) >= 5) AND regexp_matches(x, '^(?:\\d+[).:]|[-*])\\s+\\S+'))) AS BIGINT) AS list_like,
  CAST(len(list_filter(tt, lambda x: NOT (length(x) <= 140 AND regexp_matches(x, '(?i)^(?:глава|раздел|часть|chapter|section)\\s+\\d+')) AND NOT (length(x) <= 120 AND x = upper(x) AND len(regexp_extract_all(x, '[A-Za-zА-Яа-яЁё]')) >= 5) AND NOT regexp_matches(x, '^(?:\\d+[).:]|[-*])\\s+\\S+') AND regexp_matches(lower(x), 'например|пример|случай|пациент|клиент'))) AS BIGINT) AS example_or_clinical,
  CAST(1 + length(regexp_replace(text, '([.!?])\\s+([A-ZА-ЯЁ])', '\\1' || chr(1) || '\\2', 'g')) - length(replace(regexp_replace(text, '([.!?])\\s+([A-ZА-ЯЁ])', '\\1' || chr(1) || '\\2', 'g'), chr(1), '')) AS BIGINT) AS sentences,
  CAST(len(ps) AS BIGINT) AS paragraphs, CAST(coalesce(list_max(list_transform(ps, lambda p: length(p))), 0) AS BIGINT) AS longest, large,
  round(greatest(0, 1.0::DOUBLE - CASE WHEN large THEN 0.25 ELSE 0 END - CASE WHEN contains(lower(substr(text, 1, 100)), 'ocr.raw') THEN 0.05 ELSE 0 END - least(0.2::DOUBLE, {n('�')} * 0.01::DOUBLE) - least(0.15::DOUBLE, {n('[=_|]{4,}', 'substr(text, 1, 100000)')} * 0.01::DOUBLE)), 3) AS quality,
  round(CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0 ELSE len(list_intersect(wa, wb)) / least(len(wa), len(wb)) END, 6) AS overlap FROM l"""


def doc_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG-08, MSR-17, FLT-14, MSR-18, MSR-21 over whole texts as they are."""
    t = F.col("text")
    d = named(spark, sf_dir).withColumn("tail", stabilize.tail_cut(t)).withColumn("form", stabilize.form_score(t, F.col("filename"), {"license": "license", "mail": "@", "table": " | ", "stars": "***", "hashes": "###", "bang": "!!"}, ["tion", "ment"])).withColumn("stats", stabilize.paragraph_stats(t))
    d = d.withColumn("category", stabilize.logical_category(F.col("form.score"), F.length(t)))
    ready = M.readiness(F.col("stats.large"), F.col("stats.average"), F.col("tail.removed") > 0, F.lit(False), F.col("category") == "form_card")
    return d.select("doc_id", F.col("tail.removed").cast("long").alias("removed"), "tail.reason", "form.score", F.array_join("form.reasons", ",").alias("reasons"), "category", F.round(ready, 2).alias("readiness"), stabilize.retrieval_weight(F.col("category"), F.col("tail.removed") > 0, F.lit(False)).alias("weight"))


def _begins(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(tail, '(?is){pattern}') THEN length(regexp_extract(tail, '(?is)^(.*?)(?:{pattern})', 1)) + 1 ELSE 0 END"


DOC_TAILS = f"""WITH {NAMED}, a AS (SELECT *, greatest(0, length(text) - 25000) AS s, substr(text, greatest(0, length(text) - 25000) + 1) AS tail, lower(filename) || chr(10) || lower(substr(text, 1, 30000)) AS low,
  list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS ps FROM f),
b AS (SELECT *, {_begins(stabilize.PUBLISHER)} AS pub, {_begins(stabilize.BIBLIOGRAPHY)} AS bib, {_begins(stabilize.CONTENTS)} AS toc FROM a),
c AS (SELECT *, list_filter([CASE WHEN pub > 0 AND pub - 1 > length(tail) * 0.45::DOUBLE THEN {{'at': pub, 'n': 0, 'reason': 'publisher_tail'}} END,
    CASE WHEN bib > 0 AND bib - 1 > length(tail) * 0.35::DOUBLE AND {n('(?i)' + stabilize.REFERENCES, 'substr(tail, bib)')} >= 4 THEN {{'at': bib, 'n': 1, 'reason': 'bibliography_tail'}} END,
    CASE WHEN toc > 0 AND toc - 1 > length(tail) * 0.4::DOUBLE AND {n('(?i)' + stabilize.CHAPTER, 'substr(tail, toc)')} >= 3 THEN {{'at': toc, 'n': 2, 'reason': 'trailing_toc'}} END], lambda x: x IS NOT NULL) AS found FROM b),
e AS (SELECT *, list_min(found) AS first, list_filter([CASE WHEN contains(low, 'license') THEN 'license' END, CASE WHEN contains(low, '@') THEN 'mail' END, CASE WHEN contains(low, ' | ') THEN 'table' END, CASE WHEN contains(low, '***') THEN 'stars' END, CASE WHEN contains(low, '###') THEN 'hashes' END, CASE WHEN contains(low, '!!') THEN 'bang' END], lambda x: x IS NOT NULL) AS rs FROM c),
g AS (SELECT *, CASE WHEN first IS NOT NULL AND length(text) - s - first.at + 1 >= 300 THEN length(text) - s - first.at + 1 ELSE 0 END AS removed,
  greatest(0, round(least(1.0::DOUBLE, len(rs) * 0.12::DOUBLE + least({n('[?]', 'low')}, 12) * 0.015::DOUBLE + least({n(':', 'low')} / greatest(length(low) / 1000.0::DOUBLE, 1), 10) * 0.02::DOUBLE) - CASE WHEN {n('tion', 'low')} + {n('ment', 'low')} >= 8 AND length(text) > 20000 THEN 0.25::DOUBLE ELSE 0 END, 2)) AS score FROM e),
h AS (SELECT *, CASE WHEN score >= 0.42 AND length(text) < 80000 THEN 'form_card' ELSE 'explanatory_narrative' END AS category FROM g)
SELECT doc_id, CAST(removed AS BIGINT) AS removed, CASE WHEN removed > 0 THEN first.reason ELSE '' END AS reason, score, array_to_string(rs, ',') AS reasons, category,
  round(greatest(0, least(1, 1.0::DOUBLE - CASE WHEN len(ps) <= 2 AND length(text) > 10000 THEN 0.35::DOUBLE ELSE 0 END - CASE WHEN round(length(text) / greatest(len(ps), 1), 1) > 2400 THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN removed > 0 THEN 0.04::DOUBLE ELSE 0 END - CASE WHEN category = 'form_card' THEN 0.2::DOUBLE ELSE 0 END)), 2) AS readiness,
  CASE WHEN category = 'form_card' THEN 0.0 WHEN removed > 0 THEN 1.05 ELSE 1.0 END::DOUBLE AS weight FROM h"""


def doc_stabilize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIP-02, SEG-07, WIN-05, JON-08."""
    d = stabilize.stabilized(named(spark, sf_dir).select("doc_id", "text", "filename"))
    return d.withColumns({"stabilized_text": F.md5("stabilized_text"), "form_reasons": F.array_join("form_reasons", ",")})


def stabilize_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stabilize.summary(stabilize.stabilized(named(spark, sf_dir).select("doc_id", "text", "filename")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = named(spark, sf_dir).withColumn("size", F.octet_length("text").cast("long"))
    return dedupe.exact_duplicates(d, F.sha2("text", 256)).withColumn("duplicate", F.col("duplicate_of").isNotNull())


def source_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.triage(files(spark, sf_dir), LEXICON).select("doc_id", "category", "confidence", "action", "target")


def source_triage_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-07 with the rules as a table (JON-11): the rows of source_triage."""
    return triage.triage(files(spark, sf_dir), triage.rules_table(spark, LEXICON)).select("doc_id", "category", "confidence", "action", "target")


def chunk_record_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-17 where records lack something: by the length of its text a record loses the text, its id, its metadata or the name of its source."""
    r = ingest.chunk_records(records(spark, sf_dir), namespace="test").withColumn("at", F.col("metadata.char_count") % 6)
    lost = F.col("metadata").withField("source_file", F.lit(None).cast("string"))
    none = F.lit(None).cast(r.schema["metadata"].dataType)
    r = r.withColumns({"text": F.when(F.col("at") != 0, F.col("text")).otherwise(""), "chunk_id": F.when(F.col("at") != 1, F.col("chunk_id")), "metadata": F.when(F.col("at") == 2, none).when(F.col("at") == 3, lost).otherwise(F.col("metadata"))})
    return ingest.record_warnings(r).groupBy("at", F.array_join("warnings", ",").alias("warnings")).agg(F.count("*").alias("n"))


def source_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12."""
    return triage.triage(files(spark, sf_dir), LEXICON).groupBy("category", "target").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def _family(name: str) -> str:
    return "(" + " + ".join(n("(?i)" + p, "full_text") for p in LEXICON[name]) + ")"


MEASURED = f"""{NAMED}, a AS (SELECT *, lower(filename) || chr(10) || lower(text) AS full_text, lower(filename) AS low, strlen(text) AS size, length(text) AS chars, lower(regexp_extract(filename, '.\\.([^.]*)$', 1)) AS ext, substr(text, 1, 50000) AS t, doc_id <> min(doc_id) OVER (PARTITION BY text) AS duplicate FROM f),
b AS (SELECT *, {', '.join(f'{_family(k)} AS {k}' for k in LEXICON)}, {n('(?m)^\\s*(?:\\d{1,3}[).:]|[a-zA-Zа-яА-Я][).:])\\s+\\S+')} AS numbered, list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ') <> '') AS ls FROM a),
m AS (SELECT *, bib / greatest(chars / 10000.0::DOUBLE, 1) AS bibd, (1 - {n('[A-Za-zА-Яа-яЁё]', 't')} / greatest(length(t), 1)) * 0.6::DOUBLE + len(list_filter(ls, lambda x: length(trim(x, ' ')) <= 3)) / greatest(len(ls), 1) * 0.4::DOUBLE + least(0.4::DOUBLE, {n('�', 't')} / greatest(length(t), 1) * 10) AS noise FROM b)"""
TRIAGED = f"""{MEASURED}, r AS (SELECT *, CASE WHEN duplicate THEN 'duplicate' WHEN ext = 'pdf' AND chars = 0 THEN 'ocr_required' WHEN contains(low, 'preprocessing_report') THEN 'report' WHEN chars > 2000 AND noise >= 0.56 AND theory < 5 THEN 'ocr_noise' WHEN (bib >= 8 AND (chars < 25000 OR bibd >= 7 OR theory < 8)) OR (contains(low, 'литература') AND bib >= 2) THEN 'bibliography'
  WHEN size >= 512000 AND (regexp_matches(low, '{triage.BOOK_NAME}') OR theory >= 15) THEN 'book_theory' WHEN regexp_matches(low, '{triage.TEST_NAME}') THEN 'test_name' WHEN quest >= 2 OR (quest >= 1 AND numbered >= 8) THEN 'questionnaire' WHEN test >= 4 OR (test >= 2 AND numbered >= 10) THEN 'test' WHEN exer >= 4 OR (exer >= 2 AND numbered >= 6) THEN 'exercise'
  WHEN ext = 'pdf' AND size >= 5242880 THEN 'book_pdf' WHEN chars >= 8000 AND theory >= 8 THEN 'good_source' WHEN chars >= 1500 AND (article >= 1 OR theory >= 4) THEN 'article' WHEN chars = 0 AND ext = 'doc' THEN 'no_text' ELSE 'unclear' END AS k FROM m),
q AS (SELECT *, CASE k WHEN 'report' THEN 'unclear' WHEN 'no_text' THEN 'unclear' WHEN 'test_name' THEN 'test' WHEN 'book_pdf' THEN 'book_theory' ELSE k END AS category,
  round(CASE k WHEN 'duplicate' THEN 0.98 WHEN 'ocr_required' THEN 0.92 WHEN 'report' THEN 0.82 WHEN 'ocr_noise' THEN round(0.75::DOUBLE + least(noise - 0.56::DOUBLE, 0.2), 2) WHEN 'bibliography' THEN least(0.95, 0.65::DOUBLE + bib / 100) WHEN 'book_theory' THEN 0.84 WHEN 'test_name' THEN 0.86 WHEN 'questionnaire' THEN least(0.96::DOUBLE, 0.66::DOUBLE + quest / 30 + least(numbered, 30) / 100)
    WHEN 'test' THEN least(0.95::DOUBLE, 0.62::DOUBLE + test / 40 + least(numbered, 40) / 120) WHEN 'exercise' THEN least(0.9::DOUBLE, 0.6::DOUBLE + exer / 40) WHEN 'book_pdf' THEN CASE WHEN regexp_matches(low, '{triage.BOOK_NAME}') THEN 0.82 ELSE 0.68 END WHEN 'good_source' THEN least(0.9::DOUBLE, 0.62::DOUBLE + theory / 100) WHEN 'article' THEN least(0.84::DOUBLE, 0.58::DOUBLE + (article + theory) / 80) WHEN 'no_text' THEN 0.45 ELSE 0.5 END::DOUBLE, 6) AS confidence FROM r),
z AS (SELECT *, CASE WHEN category = 'duplicate' THEN 'review_duplicate_do_not_ingest' WHEN category = 'ocr_required' THEN 'copy_to_ocr_queue' WHEN category IN ('ocr_noise', 'unclear') THEN 'copy_for_manual_review' WHEN category IN ('good_source', 'book_theory', 'article') THEN 'copy_to_source_bucket_then_prepare_cleaning' ELSE 'copy_to_specialized_bucket' END AS action,
  'sorted_sources/' || CASE category WHEN 'good_source' THEN 'good' WHEN 'book_theory' THEN 'good' WHEN 'article' THEN 'good' WHEN 'test' THEN 'tests' WHEN 'questionnaire' THEN 'surveys' WHEN 'exercise' THEN 'exercises' WHEN 'bibliography' THEN 'bibliography' WHEN 'ocr_required' THEN 'ocr_required' WHEN 'ocr_noise' THEN 'trash' ELSE 'unclear' END AS target FROM q)"""


def source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-08, PIP-06."""
    return triage.measured(files(spark, sf_dir), LEXICON).select("doc_id", triage.audit_hint().alias("hint"), triage.source_kind(F.col("filename")).alias("kind"))


SOURCE_AUDIT = f"""WITH {MEASURED} SELECT doc_id, CASE WHEN test >= 3 OR (test >= 1 AND numbered >= 15) THEN 'test_or_questionnaire' WHEN bib >= 5 OR contains(low, 'литература') THEN 'bibliography_like' WHEN exer >= 3 THEN 'exercise_like' WHEN ext = 'pdf' AND size >= 5242880 THEN 'book_like' WHEN regexp_matches(low, '{triage.BOOK_NAME}') AND size >= 307200 THEN 'book_like'
  WHEN size >= 20480 THEN 'source_doc_like' ELSE 'small_source_or_unclear' END AS hint, CASE WHEN ext = 'pdf' THEN 'pdf' WHEN ext = 'docx' THEN 'docx' ELSE 'text' END AS kind FROM m"""


def source_roll_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = named(spark, sf_dir).select("source", triage.extension(F.col("filename")).alias("e"), F.octet_length("text").cast("long").alias("size"))
    return triage.roll_ups(d, "source", "e", "size")


SOURCE_ROLL_UPS = f"""WITH {NAMED}, a AS (SELECT source, lower(regexp_extract(filename, '.\\.([^.]*)$', 1)) AS e, strlen(text) AS size FROM f)
SELECT source AS folder, '' AS ext, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, round(sum(size) / 1024, 1) AS kb FROM a GROUP BY source UNION ALL SELECT '', e, count(*), CAST(sum(size) AS BIGINT), round(sum(size) / 1024, 1) FROM a GROUP BY e"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the items of a cleaning report: label and action by size alone."""
    size = F.length("text")
    label = F.when(size < 300, "REJECT").when(size < 1000, "LOW").when(size < 4000, "MEDIUM").otherwise("HIGH")
    d = docs(spark, sf_dir).withColumn("quality_label", label).withColumn("recommended_action", M.cleaner_action(F.col("quality_label")))
    return d.withColumn("included", ingest.included(F.col("quality_label"), F.col("recommended_action")) & ingest.long_enough(F.col("text")))


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = segment.word_windows(items(spark, sf_dir).filter("included").select(F.col("doc_id").alias("item_id"), "text")).filter(ingest.long_enough(F.col("chunk"), 50)).withColumn("seq", F.col("item_id") * 100_000 + F.col("chunk_index"))
    there = chunks.filter("item_id % 10 = 0").select(F.sha1(X.hash_key(F.col("chunk"))).alias("hash"))
    return ingest.planned_chunks(chunks.filter("item_id % 10 != 0").drop("text"), there, kb="kb", session="s1", span=1000 * 100_000)


def ingest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIP-09, FLT-12, FLT-15, JON-05, WIN-03: items whose id ends in 0 are in production, the others are the session."""
    return plan(spark, sf_dir).select("item_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_id", "tokens", "duplicate_status", F.coalesce("duplicate_of", F.lit(-1)).alias("duplicate_of"))


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.plan_summary(items(spark, sf_dir), plan(spark, sf_dir))


ITEMS = """i AS (SELECT *, CASE WHEN length(text) < 300 THEN 'REJECT' WHEN length(text) < 1000 THEN 'LOW' WHEN length(text) < 4000 THEN 'MEDIUM' ELSE 'HIGH' END AS quality_label, length(text) >= 1000 AND length(trim(text, ' ')) >= 100 AS included FROM d)"""
PLAN = f"""WITH {DOCS}, {ITEMS}, w AS (SELECT doc_id, source, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM i WHERE included), {CHUNKS}, p AS (SELECT doc_id AS item_id, i AS chunk_index, array_to_string(p, ' ') AS t, sha1(trim(lower(regexp_replace(array_to_string(p, ' '), '\\s+', ' ', 'g')), ' ')) AS hash FROM k WHERE length(array_to_string(p, ' ')) >= 50),
s AS (SELECT *, lag(item_id * 100000 + chunk_index) OVER (PARTITION BY hash ORDER BY item_id, chunk_index) AS before FROM p WHERE item_id % 10 <> 0),
x AS (SELECT item_id, chunk_index, sha1('kb:s1:' || item_id || ':' || chunk_index || ':' || hash) AS chunk_id, CAST(ceil(length(t) / 4.0::DOUBLE) AS BIGINT) AS tokens, CASE WHEN hash IN (SELECT hash FROM p WHERE item_id % 10 = 0) THEN 'duplicate_candidate_current' WHEN before IS NOT NULL THEN 'duplicate_candidate_session' ELSE 'canonical_or_unique' END AS duplicate_status, coalesce(before, -1) AS duplicate_of FROM s)"""
INGEST_SUMMARY = f"""{PLAN}, y AS (SELECT count(*) AS items, count(*) FILTER (WHERE included) AS sources, count(*) FILTER (WHERE NOT included) AS rejected, count(*) FILTER (WHERE quality_label = 'HIGH') AS high, count(*) FILTER (WHERE quality_label = 'MEDIUM') AS medium, count(*) FILTER (WHERE quality_label = 'LOW') AS low, count(*) FILTER (WHERE quality_label = 'REJECT') AS reject FROM i),
z AS (SELECT count(*) AS chunks, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, count(*) FILTER (WHERE duplicate_status <> 'canonical_or_unique') AS duplicates FROM x) SELECT y.*, z.*, round(tokens / 1e6::DOUBLE * 0.02::DOUBLE, 8) AS cost FROM y, z"""


def cleaning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15."""
    d = items(spark, sf_dir).withColumns({"chars_before": F.length("text"), "chars_after": F.length(F.regexp_replace("text", r"\s+", " "))})
    return ingest.cleaning_summary(d)


CLEANING_SUMMARY = f"""WITH {DOCS}, {ITEMS}, a AS (SELECT *, length(text) AS x, length(regexp_replace(text, '\\s+', ' ', 'g')) AS y FROM i)
SELECT count(*) AS items, count(*) FILTER (WHERE quality_label = 'HIGH') AS high, count(*) FILTER (WHERE quality_label = 'MEDIUM') AS medium, count(*) FILTER (WHERE quality_label = 'LOW') AS low, count(*) FILTER (WHERE quality_label = 'REJECT') AS reject, count(*) FILTER (WHERE quality_label <> 'REJECT') AS kept,
  CAST(sum(x) AS BIGINT) AS chars_before, CAST(sum(y) AS BIGINT) AS chars_after, CAST(sum(CASE WHEN quality_label <> 'REJECT' THEN ceil(y / 4.0::DOUBLE) ELSE 0 END) AS BIGINT) AS tokens FROM a"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedupe.exact_duplicates(docs(spark, sf_dir), F.sha2("text", 256)).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source_file"), F.concat(F.lit("doc/"), F.col("duplicate_of").cast("string")).alias("duplicate_of"), "source", "text")
    status = F.when(F.col("duplicate_of").isNotNull(), "duplicate_candidate")
    c = segment.word_windows(d.withColumns({"duplicate_status": status, "logical_category": F.lit(None).cast("string"), "tail_removed": F.lit(0), "restore_splits": F.lit(0), "readiness_before": F.lit(1.0), "readiness_after": F.lit(1.0), "similarity": F.lit(1.0)}))
    first = F.col("chunk_index") * 450
    return c.withColumns({"first_paragraph": first, "last_paragraph": first + F.col("n_words") - 1, "tokens": M.tokens_by_words(F.col("chunk")), "continuity": F.lit(0.82), "redundancy": F.lit(0.0)})


def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-07, MSR-24, FLT-17: word windows as chunks, their places as paragraph range."""
    r = ingest.record_warnings(ingest.chunk_records(records(spark, sf_dir), namespace="test"))
    return r.select("chunk_id", "metadata.source_file", "metadata.canonical_source", "metadata.duplicate_status", F.col("metadata.token_estimate").alias("tokens"), F.col("metadata.char_count").cast("long").alias("chars"), "metadata.quality.oversized", F.array_join("warnings", ",").alias("warnings"))


def embedding_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17."""
    d = records(spark, sf_dir)
    r = ingest.record_warnings(ingest.chunk_records(d, namespace="test")).withColumn("file", F.col("metadata.source_file"))
    return ingest.embedding_sizes(r, "file").withColumn("cost", r6(F.col("cost")))


RECORDS = f"""WITH {DOCS}, e AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS own FROM d), w AS (SELECT doc_id, own, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM e),
c AS (SELECT doc_id, own, unnest(range(0, CAST(ceil(len(ws) / 450.0) AS BIGINT))) AS i, ws FROM w), k AS (SELECT doc_id, own, i, len(ws[i * 450 + 1 : i * 450 + 500]) AS m, array_to_string(ws[i * 450 + 1 : i * 450 + 500], ' ') AS t FROM c),
r AS (SELECT sha1('doc/' || own || '[' || (i * 450) || ',' || (i * 450 + m - 1) || ']' || trim(lower(t), ' ')) AS chunk_id, 'doc/' || doc_id AS source_file, 'doc/' || own AS canonical_source, CASE WHEN own <> doc_id THEN 'duplicate_candidate' ELSE 'canonical_or_unique' END AS duplicate_status, CAST(greatest(m, round_even(greatest(length(t), 1) / 4.2::DOUBLE, 0)) AS BIGINT) AS tokens, length(t) AS chars, t FROM k)"""
CHUNK_RECORD_WARNINGS = f"""{RECORDS} SELECT chars % 6 AS at, CASE chars % 6 WHEN 0 THEN 'missing_text' WHEN 1 THEN 'missing_chunk_id' WHEN 2 THEN 'missing_metadata,metadata_missing_source_file,metadata_missing_canonical_source,metadata_missing_paragraph_range,metadata_missing_chunk_index,metadata_missing_token_estimate'
  WHEN 3 THEN 'metadata_missing_source_file' ELSE '' END AS warnings, count(*) AS n FROM r GROUP BY 1, 2"""
CHUNK_RECORDS = f"{RECORDS} SELECT chunk_id, source_file, canonical_source, duplicate_status, tokens, chars, tokens > 1150 AS oversized, '' AS warnings FROM r"
EMBEDDING_SIZES = f"{RECORDS} SELECT source_file AS file, count(*) AS records, CAST(sum(ceil(length(t) / 4.0::DOUBLE)) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS invalid, round(round(sum(ceil(length(t) / 4.0::DOUBLE)) / 1e6::DOUBLE * 0.02::DOUBLE, 8), 6) AS cost FROM r GROUP BY source_file"


def clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIP-01 with the block ladder."""
    t = F.col("text")

    def classify(b: DataFrame) -> DataFrame:
        m = {"dup": F.lit(0), "chars": F.length(t), "theory": M.theory_score(t, LEXICON["theory"]), "noise": M.block_noise(t), "num": F.col("__shares")[0], "toc": F.col("__shares")[1], "ref": F.col("__shares")[2], **{k: M.hits(t, LEXICON[k]) for k in ("bib", "quest", "test", "exer", "tocw", "chap")}, "scoring": t.contains("%"), "instr": t.contains("$"), "clinical": t.contains("&")}
        b = b.withColumn("__shares", M.line_shares(t, M.NUMBERED, M.CONTENTS, M.REFERENCE)).withColumns({f"m_{k}": v for k, v in m.items()})
        return b.withColumn("__b", M.block_ladder({k: F.col(f"m_{k}") for k in m})).select("doc_id", "block_index", "heading", "text", "__b.*")

    reports, _ = cleaning.cleaned(docs(spark, sf_dir).select("doc_id", "text"), classify, preserve_paragraphs=True)
    lists = {c: F.coalesce(F.array_join(c, ","), F.lit("")) for c in ("labels_kept", "labels_removed", "warnings")}
    return cleaning.public(reports.withColumns({"cleaned": F.md5("_cleaned_text"), **lists}))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text")
    return retrieve.context(retrieval.found(spark, sf_dir).join(d, "article_id"), 40_000, first_always=False, separator=2)


def prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIP-11."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieve.prompts(q, contexts(spark, sf_dir)).select("query_id", F.md5("prompt").alias("prompt"))


CONTEXTS = f"""{retrieval.FOUND_SQL}, x AS (SELECT query_id, rank, text, sum(length(text) + 2) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM g JOIN documents ON doc_id = article_id),
y AS (SELECT *, min(CASE WHEN used > 40000 THEN rank END) OVER (PARTITION BY query_id) AS cut FROM x), z AS (SELECT query_id, count(*) AS blocks, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM y WHERE cut IS NULL OR rank < cut GROUP BY query_id)"""
PROMPT_ROWS = f"""WITH {CONTEXTS} SELECT item_id AS query_id, md5('USER_QUERY:' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'RETRIEVED_CONTEXT:' || chr(10) || coalesce(context, '')) AS prompt FROM benchmark LEFT JOIN z ON query_id = item_id"""


def labelled_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of query k * 50 as those of item k, with the source's label."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", retrieve.source_label(F.lit(""), F.col("label")).alias("source"))
    return retrieval.hits(spark, sf_dir).withColumn("query_id", (F.col("query_id") / 50).cast("long")).join(v, "vec_id")


def retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIP-12, PIP-10, MSR-32."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    out = retrieve.report(q, labelled_hits(spark, sf_dir), contexts(spark, sf_dir), "source")
    return out.select("query_id", "retrieved", "confidence", "label", F.coalesce(F.array_join("sources", ","), F.lit("")).alias("sources"), "context_chunks", F.col("context_chars").cast("long").alias("context_chars"))


LABELLED = "lh AS (SELECT query_id // 50 AS query_id, rank, score, CAST(label AS VARCHAR) AS source, vec_id FROM h)"
RETRIEVAL_REPORT = f"""WITH {retrieval.HITS_SQL}, {CONTEXTS}, {LABELLED}, c1 AS (SELECT query_id, count(*) AS n, max(score) AS best, avg(CASE WHEN rank <= 3 THEN score END) AS top3 FROM lh GROUP BY query_id), s1 AS (SELECT query_id, source, max(score) AS best FROM lh GROUP BY 1, 2), s2 AS (SELECT query_id, string_agg(source, ',' ORDER BY best DESC, source) AS sources FROM s1 GROUP BY query_id)
SELECT item_id AS query_id, coalesce(n, 0) AS retrieved, coalesce(round(best * 0.55::DOUBLE + top3 * 0.35::DOUBLE + least(n, 5) / 5 * 0.10::DOUBLE, 6), 0) AS confidence, CASE WHEN best >= 0.45 AND top3 >= 0.38 AND n >= 3 THEN 'high' WHEN best >= 0.34 AND top3 >= 0.28 THEN 'medium' ELSE 'low' END AS label,
  coalesce(sources, '') AS sources, coalesce(blocks, 0) AS context_chunks, coalesce(length(context), 0) AS context_chars FROM benchmark b LEFT JOIN c1 ON c1.query_id = item_id LEFT JOIN s2 ON s2.query_id = item_id LEFT JOIN z ON z.query_id = item_id"""


def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20: hits whose vector's id is divisible by 97 count as flagged."""
    out = retrieve.quality(labelled_hits(spark, sf_dir).withColumn("flagged", F.col("vec_id") % 97 == 0), "source", "flagged")
    return out.withColumns({"top": r6(F.col("top")), "average": r6(F.col("average"))})


RETRIEVAL_QUALITY = f"""WITH {retrieval.HITS_SQL}, {LABELLED}, a AS (SELECT query_id, max(score) AS top, avg(score) AS average, count(DISTINCT source) AS sources, count(*) FILTER (WHERE vec_id % 97 = 0) AS flagged FROM lh GROUP BY query_id)
SELECT query_id, round(top, 6) AS top, round(average, 6) AS average, sources, flagged, CASE WHEN top >= 0.42 AND average >= 0.32 AND flagged = 0 THEN 'good' WHEN top >= 0.34 AND flagged <= 1 THEN 'medium' ELSE 'low' END AS label FROM a"""


def vector_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-01: vectors with the document of their id, where it has one."""
    v = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 3).alias("chunk_id"), "label")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieve.with_texts(v, d).select("chunk_id", "label", F.md5("text").alias("text"), F.coalesce("warning", F.lit("")).alias("warning"))


VECTOR_TEXTS = "SELECT vec_id * 3 AS chunk_id, label, md5(coalesce(text, '')) AS text, CASE WHEN text IS NULL THEN 'missing_chunk_text' ELSE '' END AS warning FROM embeddings LEFT JOIN documents ON doc_id = vec_id * 3"


def index_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-02: vectors as an index whose manifest names another number of them."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vector_id"), F.col("vec_id").cast("string").alias("chunk_id"), F.lit("text").alias("text"), F.col("label").alias("source_id"), F.size("embedding").alias("embedding_dim"))
    return ingest.manifest_checks(rows, {"index_type": "faiss.IndexFlatIP", "embedding_dim": 64, "vectors": 499, "kb_id": "a"}, {"kb_id": "b", "summary": {"planned_sources": 0}}, dim=64)


INDEX_MANIFEST = """WITH a AS (SELECT count(*) AS rows, count(DISTINCT label) AS sources, count(DISTINCT vec_id) AS ids, min(vec_id) AS low, max(vec_id) AS high, count(*) FILTER (WHERE len(embedding) <> 64) AS bad FROM embeddings)
SELECT rows, sources, array_to_string(list_filter([CASE WHEN rows <> 499 THEN 'manifest_vectors' END, CASE WHEN ids <> rows THEN 'duplicate_chunk_id' END, CASE WHEN bad > 0 THEN 'row_dim' END, CASE WHEN NOT (rows = 0 OR (low = 0 AND high = rows - 1 AND ids = rows)) THEN 'vector_id' END, 'kb_id', CASE WHEN sources <> 0 THEN 'planned_sources' END], lambda x: x IS NOT NULL), ',') AS errors, 'staging_only_unconfirmed' AS warnings, false AS ok FROM a"""


def usage_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-14: an event's type is the preset."""
    return usage.recent_presets(events(spark, sf_dir), "event_type").select("user_id", "event_type", F.col("place").cast("long").alias("place"))


USAGE_PRESETS = """WITH a AS (SELECT user_id, event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS e FROM events GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, e DESC, event_type) AS place FROM a) SELECT user_id, event_type, place FROM b WHERE place <= 3"""


def usage_latest_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-11, MSR-30: events as sessions, of which signups and clicks are open; days since each."""
    s = events(spark, sf_dir).select("user_id", F.col("event_id").alias("session_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("status"))
    return usage.latest_sessions(s, "signup", "click").select("user_id", "session_id", "status", usage.days_used(F.col("created_at"), F.expr("TIMESTAMP '2024-02-01 00:00:00'")).cast("long").alias("days"))


USAGE_LATEST_SESSION = """WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type IN ('signup', 'click'))
SELECT user_id, event_id AS session_id, event_type AS status, CAST(ceil((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) / 86400e6::DOUBLE) AS BIGINT) AS days FROM a WHERE r = 1"""


def user_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-20, JON-16: customers with the wanted text in name or segment, and their orders."""
    found = usage.find_users(table(spark, sf_dir, "customer"), "AUTO", "c_name", "c_mktsegment").select(F.col("c_custkey").alias("code"), "c_name")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code"), "o_orderkey")
    return usage.by_code(orders, found, "code").groupBy("code", F.coalesce("c_name", F.lit("")).alias("name")).agg(F.count("*").alias("orders"))


USER_SEARCH = "SELECT o_custkey AS code, coalesce(c_name, '') AS name, count(*) AS orders FROM orders LEFT JOIN (SELECT * FROM customer WHERE contains(lower(c_name), 'auto') OR contains(lower(c_mktsegment), 'auto')) ON c_custkey = o_custkey GROUP BY 1, 2"


def rollback_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-11: what takes a copy plan back."""
    d = named(spark, sf_dir).select("doc_id", F.concat(F.lit("in/"), F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("target"), F.concat("source", F.lit(".txt")).alias("name"))
    return sinks.rollback_manifest(sinks.copy_plan(d, "target", "name", "doc_id"), "path", "target", "target_name")[1]


ROLLBACK_MANIFEST = """WITH a AS (SELECT doc_id, lang, coalesce(source, '') AS source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents)
SELECT concat_ws('/', lang, source || CASE WHEN n = 1 THEN '' ELSE '__' || (n - 1) END || '.txt') AS delete, 'in/' || doc_id AS was FROM a"""

def block_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01, AGG-03: blocks and characters for each label, with its share of all, most common first."""
    by = blocks(spark, sf_dir).groupBy("action", "label").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    return by.withColumn("place", F.row_number().over(W.partitionBy("action").orderBy(F.desc("n"), "label")).cast("long"))


_BLOCKS = BLOCK_CLASSIFY.rsplit("\nSELECT", 1)[0]
BLOCK_HISTOGRAM = f"""{_BLOCKS}, y AS (SELECT CASE WHEN label LIKE 'reject%' THEN 'reject' ELSE 'keep' END AS action, label, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM g GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY action ORDER BY n DESC, label) AS place FROM y"""


def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06: chunks of each source: number, sum, mean, least and most of their tokens, oversized and orphaned ones."""
    c = segment.word_windows(docs(spark, sf_dir).select("source", "text")).withColumn("tokens", M.tokens_by_words(F.col("chunk")))
    return c.groupBy("source").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"), r6(F.avg("tokens")).alias("mean"), F.min("tokens").alias("least"), F.max("tokens").alias("most"), F.count_if(F.col("tokens") > segment.HARD).alias("oversized"), F.count_if(F.col("tokens") < segment.ORPHAN).alias("orphans"))


CHUNK_SUMMARY = f"""WITH {DOCS}, {DOC_WORDS}, {CHUNKS}, t AS (SELECT source, CAST(greatest(len(p), round_even(greatest(length(array_to_string(p, ' ')), 1) / 4.2::DOUBLE, 0)) AS BIGINT) AS tokens FROM k)
SELECT source, count(*) AS chunks, CAST(sum(tokens) AS BIGINT) AS tokens, round(avg(tokens), 6) AS mean, min(tokens) AS least, max(tokens) AS most, count(*) FILTER (WHERE tokens > 1150) AS oversized, count(*) FILTER (WHERE tokens < 220) AS orphans FROM t GROUP BY source"""


def doc_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04: texts whose first 1,200 normalised characters were seen before, and MSR-10."""
    d = dedupe.exact_duplicates(docs(spark, sf_dir), dedupe.opening(F.col("text")))
    return d.select("doc_id", F.coalesce("duplicate_of", F.lit(-1)).alias("duplicate_of"), "n_same", F.size(F.split("text", "\n")).cast("long").alias("lines"), F.regexp_count("text", F.lit("(?m)" + M.NUMBERED)).cast("long").alias("numbered"))


DOC_FIRST_SEEN = f"""WITH {DOCS}, a AS (SELECT *, substr(trim(lower(regexp_replace(text, '\\s+', ' ', 'g')), ' '), 1, 1200) AS k FROM d), b AS (SELECT *, min(doc_id) OVER (PARTITION BY k) AS first, count(*) OVER (PARTITION BY k) AS n_same FROM a)
SELECT doc_id, CASE WHEN doc_id > first THEN first ELSE -1 END AS duplicate_of, n_same, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, CAST({n('(?m)^\\s*(?:\\d{1,3}[).:]|[a-zA-Zа-яА-Я][).:])\\s+\\S+')} AS BIGINT) AS numbered FROM b"""


def intake_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items of an intake: kind and ending go by the id; items of an url have no text yet."""
    kind = F.when(F.col("doc_id") % 7 == 0, "url").when(F.col("doc_id") % 2 == 0, "text").otherwise("file")
    d = docs(spark, sf_dir).withColumn("kind", kind).withColumn("ext", F.element_at(F.array(*map(F.lit, ["txt", "pdf", "exe", "docx"])), (F.col("doc_id") % 4 + 1).cast("int")))
    d = d.withColumn("text", F.when(F.col("kind") == "url", "").otherwise(F.col("text"))).withColumn("extraction", M.extraction_status(F.col("kind"), F.col("ext"), F.col("text")))
    d = d.withColumn("text", F.when(F.col("extraction") == "unsupported", "").otherwise(F.col("text"))).withColumn("signals", M.intake_signals(F.col("text")))
    d = dedupe.exact_duplicates(d.withColumn("score", M.intake_score(F.length("text"), F.col("signals"), F.col("extraction"))), F.sha1(X.hash_key(F.col("text"))))
    risk = F.when((F.col("text") != "") & F.col("duplicate_of").isNotNull(), "high").otherwise("low")
    return d.withColumn("risk", risk).withColumn("action", M.intake_action(F.col("extraction"), F.col("score"), F.col("risk"))).withColumn("status", M.final_status(F.col("extraction"), F.col("score"), F.col("risk")))


def doc_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-10, FLT-11, MSR-12, MSR-14, WIN-02, PIP-07."""
    return intake_rows(spark, sf_dir).select("doc_id", "extraction", r6(F.col("score")).alias("score"), "risk", "action", "status")


def intake_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14: items by extraction status, and by their status where that is another one."""
    d = intake_rows(spark, sf_dir).select(F.explode(F.array_distinct(F.array("extraction", "status"))).alias("status"))
    return d.groupBy("status").agg(F.count("*").alias("items"))


_INTAKE = DOC_QUALITY.rsplit("\n), q AS", 1)[0].replace(DOCS, f"""{DOCS.replace('d AS', 'd0 AS')}, d1 AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'url' WHEN doc_id % 2 = 0 THEN 'text' ELSE 'file' END AS kind, ['txt', 'pdf', 'exe', 'docx'][doc_id % 4 + 1] AS ext FROM d0),
d2 AS (SELECT *, CASE WHEN kind = 'url' THEN '' ELSE text END AS t1 FROM d1), d3 AS (SELECT *, CASE WHEN kind = 'url' THEN 'url_pending' WHEN kind <> 'text' AND ext = 'exe' THEN 'unsupported' WHEN kind = 'file' AND ext = 'pdf' AND length(trim(t1, ' ')) < 500 THEN 'ocr_required' WHEN trim(t1, ' ') = '' THEN 'needs_review' ELSE 'extracted' END AS extraction FROM d2),
d AS (SELECT doc_id, CASE WHEN extraction = 'unsupported' THEN '' ELSE t1 END AS text, extraction FROM d3)""")
INTAKE = f"""{_INTAKE}), q AS (SELECT s.*, extraction, CASE WHEN extraction IN ('unsupported', 'ocr_required', 'url_pending') THEN 0 ELSE round(greatest(0, least(1, 1.0::DOUBLE - CASE WHEN n < 1000 THEN 0.25 ELSE 0 END - CASE WHEN n < 300 THEN 0.25 ELSE 0 END - 0.12::DOUBLE * len(a))), 2) END::DOUBLE AS score,
  CASE WHEN text <> '' AND doc_id > min(doc_id) OVER (PARTITION BY trim(lower(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) THEN 'high' ELSE 'low' END AS risk FROM s JOIN (SELECT doc_id, extraction FROM d) USING (doc_id)),
o AS (SELECT *, CASE extraction WHEN 'ocr_required' THEN 'send_to_ocr' WHEN 'url_pending' THEN 'fetch_url_or_manual_review' WHEN 'unsupported' THEN 'reject_or_convert_manually' ELSE CASE WHEN risk = 'high' THEN 'review_duplicate_before_cleaning' WHEN score >= 0.65 THEN 'ready_for_cleaning' ELSE 'needs_review' END END AS action,
  CASE WHEN extraction IN ('ocr_required', 'url_pending', 'unsupported') THEN extraction WHEN risk = 'high' OR score < 0.65 THEN 'needs_review' ELSE 'ready_for_cleaning' END AS status FROM q)"""
DOC_INTAKE = f"{INTAKE} SELECT doc_id, extraction, round(score, 6) AS score, risk, action, status FROM o"
INTAKE_SUMMARY = f"{INTAKE} SELECT status, count(*) AS items FROM (SELECT extraction AS status FROM o UNION ALL SELECT status FROM o WHERE status <> extraction) GROUP BY status"


def flagged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-18: chunks with any flag of their diagnostics."""
    c = segment.word_windows(docs(spark, sf_dir).select("doc_id", "text")).withColumn("x", M.diagnostics(F.col("chunk")))
    return c.filter("x.size or x.ocr or x.encoding").select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"))


FLAGGED_CHUNKS = f"""WITH {DOCS}, {DOC_WORDS}, {CHUNKS}, t AS (SELECT doc_id, i, array_to_string(p, ' ') AS t, len(p) AS words FROM k), m AS (SELECT doc_id, i, words, length(t) AS n, {n('[А-Яа-яЁё]', 't')} AS cyr, {n('[A-Za-z]', 't')} AS lat, {n('�', 't')} AS repl, {n('(?:Р[а-яА-ЯЁёA-Z]?|С[а-яА-ЯЁёA-Z]?|вЂ|В«|В»|В©|В®)', 't')} AS moji,
  len(list_filter(regexp_extract_all(t, '[^\\p{{L}}\\p{{N}}\\s.,;:!?()"«»\\-—№%/]{{4,}}'), lambda x: NOT regexp_matches(x, '^=+$'))) AS runs, {n('\\d', 't')} AS dig, {n('===== PAGE \\d+ / \\d+ =====', 't')} AS pg FROM t)
SELECT doc_id, i AS chunk_index FROM m WHERE words < 80 OR words > 650 OR runs > 0 OR dig / n > 0.18 OR pg > 4 OR repl > 0 OR moji > 10 OR cyr / greatest(cyr + lat, 1) < 0.35"""


def result_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-08: lexical hits whose ids are known for even ones only."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.coalesce("text", F.lit("")).alias("text"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    r = retrieve.lexical(q, d, 8).join(d, "article_id").withColumn("chunk_id", F.when(F.col("article_id") % 2 == 0, F.col("article_id")))
    return retrieve.dedupe_results(r, "chunk_id", "text").select("query_id", F.col("rank").cast("long").alias("rank"), "article_id")


RESULT_DEDUPE = f"""WITH {retrieval.FOUND_SQL.replace('rank <= 3', 'rank <= 8')}, e AS (SELECT g.*, CASE WHEN article_id % 2 = 0 THEN CAST(article_id AS VARCHAR) ELSE nullif(substr(trim(lower(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' '), 1, 500), '') END AS k FROM g JOIN documents ON doc_id = article_id),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY rank) AS r FROM e WHERE k IS NOT NULL) SELECT query_id, rank, article_id FROM b WHERE r = 1"""


def intake_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIP-08, NRM-02."""
    out = cleaning.intake_cleaned(docs(spark, sf_dir).select("doc_id", "text"), {"tests": ["!!"], "questionnaires": ["@"]})
    return out.withColumns({"cleaned": F.md5("cleaned"), "signals": F.array_join("signals", ",")})


def chunk_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIP-03: stabilised documents, without those that are excluded (FLT-13), as semantic chunk records."""
    d = stabilize.stabilized(named(spark, sf_dir).select("doc_id", "text", "filename"))
    d = d.filter(stabilize.exclusion(F.col("planned_output"), F.col("duplicate_status")) == "")
    meta = d.select(F.col("filename").alias("source_file"), F.col("duplicate_of").cast("string").alias("duplicate_of"), "logical_category", "duplicate_status", "tail_removed", "restore_splits", "readiness_before", "readiness_after", "similarity", F.col("stabilized_text").alias("text"))
    r = ingest.chunk_records(segment.semantic_chunks(meta), namespace="test", language="en")
    own = r.select("chunk_id", F.md5("text").alias("text"), "metadata.*")
    own = own.withColumns({"first_paragraph": F.get("paragraph_range", F.lit(0)), "last_paragraph": F.get("paragraph_range", F.lit(1))})
    names = {"chunking_readiness_before": "readiness_before", "chunking_readiness_after": "readiness_after", "paragraph_restore_applied": "restored", "tail_cleanup_applied": "tail_cut", "semantic_continuity_score": "continuity", "overlap_redundancy": "redundancy"}
    return own.select("*", "stabilization.*", "quality.*").withColumnsRenamed(names).drop("paragraph_range", "stabilization", "quality", "duplicate_similarity")


QUERIES = {
    "doc_text_keys": (doc_text_keys, DOC_TEXT_KEYS), "page_urls": (page_urls, PAGE_URLS), "doc_structure": (doc_structure, DOC_STRUCTURE), "doc_tails": (doc_tails, DOC_TAILS), "doc_stabilize": (doc_stabilize, jobs_sql.doc_stabilize(NAMED)), "stabilize_summary": (stabilize_summary, jobs_sql.stabilize_summary(NAMED)),
    "source_triage": (source_triage, f"WITH {TRIAGED} SELECT doc_id, category, confidence, action, target FROM z"), "source_categories": (source_categories, f"WITH {TRIAGED} SELECT category, target, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM z GROUP BY 1, 2"),
    "source_triage_rules": (source_triage_rules, f"WITH {TRIAGED} SELECT doc_id, category, confidence, action, target FROM z"), "chunk_record_warnings": (chunk_record_warnings, CHUNK_RECORD_WARNINGS), "source_audit": (source_audit, SOURCE_AUDIT), "source_roll_ups": (source_roll_ups, SOURCE_ROLL_UPS), "ingest_plan": (ingest_plan, f"{PLAN} SELECT * FROM x"), "ingest_summary": (ingest_summary, INGEST_SUMMARY), "cleaning_summary": (cleaning_summary, CLEANING_SUMMARY),
    "chunk_records": (chunk_records, CHUNK_RECORDS), "embedding_sizes": (embedding_sizes, EMBEDDING_SIZES), "clean_report": (clean_report, jobs_sql.CLEAN_REPORT), "intake_cleaning": (intake_cleaning, jobs_sql.INTAKE_CLEANING), "chunk_job": (chunk_job, jobs_sql.chunk_job(NAMED)), "prompt_rows": (prompt_rows, PROMPT_ROWS), "retrieval_report": (retrieval_report, RETRIEVAL_REPORT), "retrieval_quality": (retrieval_quality, RETRIEVAL_QUALITY),
    "vector_texts": (vector_texts, VECTOR_TEXTS), "index_manifest": (index_manifest, INDEX_MANIFEST), "usage_presets": (usage_presets, USAGE_PRESETS), "usage_latest_session": (usage_latest_session, USAGE_LATEST_SESSION), "user_search": (user_search, USER_SEARCH), "rollback_manifest": (rollback_manifest, ROLLBACK_MANIFEST),
    "block_histogram": (block_histogram, BLOCK_HISTOGRAM), "chunk_summary": (chunk_summary, CHUNK_SUMMARY), "doc_first_seen": (doc_first_seen, DOC_FIRST_SEEN), "doc_intake": (doc_intake, DOC_INTAKE), "intake_summary": (intake_summary, INTAKE_SUMMARY), "flagged_chunks": (flagged_chunks, FLAGGED_CHUNKS), "result_dedupe": (result_dedupe, RESULT_DEDUPE),
}
