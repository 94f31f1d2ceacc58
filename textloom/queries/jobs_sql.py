"""SQL of the cleaning and stabilisation jobs, as chains of common table expressions for WITH RECURSIVE."""

from __future__ import annotations

from textloom.functions import measures as M
from textloom.operators import stabilize
from textloom.queries import chunk_sql
from textloom.queries.chunk_sql import SENTENCES, STRIP, filled, packed, word_end
from textloom.queries.documents import DOCS, LEXICON, NAV, family, n

NL = "chr(10) || chr(10)"
HEADING = word_end("(?i)^(?:(?:chapter|part|section|глава|часть|раздел)\\b|\\d{1,2}(?:\\.\\d{1,2}){0,3}\\.?\\s+\\S+)")


def is_heading(t: str) -> str:
    return f"(length({t}) BETWEEN 1 AND 140 AND (regexp_matches({t}, '{HEADING}') OR ({n(chr(92) + 'p{L}', t)} >= 4 AND {t} = upper({t}))))"


def tidy(t: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({t}, '[ \\t]+', ' ', 'g'), ' *\\n', chr(10), 'g'), '\\n{{3,}}', {NL}, 'g'), ' ')"


def line_clean(source: str) -> str:
    """NRM-12: lc(doc_id, cleaned, navigation, repeated, empty) of source(doc_id, text)."""
    return f"""lc0 AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, regexp_replace(unnest(ls), '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g') AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {source})),
lc1 AS (SELECT *, trim(lower(regexp_replace(line, '\\s+', ' ', 'g')), ' ') AS k, regexp_matches(line, '{NAV}') AS nav FROM lc0),
lc2 AS (SELECT *, k <> '' AND NOT nav AND row_number() OVER (PARTITION BY doc_id, k, nav ORDER BY pos) > 1 AS again FROM lc1),
lc3 AS (SELECT doc_id, pos, line, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM lc2 WHERE NOT nav AND NOT again),
lc4 AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS cleaned FROM lc3 WHERE line <> '' OR before IS DISTINCT FROM '' GROUP BY doc_id),
lc AS MATERIALIZED (SELECT doc_id, coalesce(any_value(cleaned), '') AS cleaned, count(*) FILTER (WHERE nav) AS navigation, count(*) FILTER (WHERE again) AS repeated, count(*) FILTER (WHERE k = '') AS empty FROM lc2 LEFT JOIN lc4 USING (doc_id) GROUP BY doc_id)"""


INTAKE_CLEANING = f"""WITH {DOCS}, a AS (SELECT doc_id, {tidy("regexp_replace(regexp_replace(nfc_normalize(text), '[' || chr(65279) || chr(173) || ']', '', 'g'), '[■-◿�' || chr(92) || 'x00-' || chr(92) || 'x08' || chr(92) || 'x0B' || chr(92) || 'x0C' || chr(92) || 'x0E-' || chr(92) || 'x1F]', ' ', 'g')")} AS t FROM d),
j AS (SELECT doc_id, regexp_replace(t, '(\\p{{L}})-\\n(\\p{{L}})', '\\1\\2', 'g') AS text FROM a), {line_clean('j')},
c AS (SELECT doc_id, {tidy('cleaned')} AS text, navigation, repeated, empty FROM lc),
m AS (SELECT *, length(text) AS n, {n('�')} AS repl, {n('[РС][' + chr(0x400) + '-' + chr(0x4FF) + 'A-Za-z]{2,}')} AS moji, {n(M.MOJIBAKE_MARKS)} AS marks, {n('[A-Za-zА-Яа-яЁё]')} AS al, {n('[А-Яа-яЁё]')} AS cyr, {n('[._' + chr(92) + '-–—=]{6,}')} AS runs, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')) AS ks FROM c),
s AS (SELECT *, list_filter([CASE WHEN n < 300 THEN 'ultra_short_fragments' END, CASE WHEN n > 0 AND al / greatest(n, 1) < 0.35 THEN 'low_semantic_density' END, CASE WHEN moji > 15 OR marks > 40 OR (moji > 6 AND cyr / greatest(al, 1) > 0.5) THEN 'corrupted_ocr_or_mojibake' END,
  CASE WHEN repl > 5 THEN 'broken_symbols' END, CASE WHEN runs > 3 THEN 'repeated_patterns' END, CASE WHEN len(ks) - len(list_distinct(ks)) > 5 THEN 'repeated_lines' END, CASE WHEN contains(text, '!!') THEN 'tests' END, CASE WHEN contains(text, '@') THEN 'questionnaires' END], lambda x: x IS NOT NULL) AS b FROM m),
v AS (SELECT *, len(list_filter(b, lambda x: x IN ('low_semantic_density', 'corrupted_ocr_or_mojibake'))) AS severe FROM s),
w AS (SELECT *, CASE WHEN regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g') = '' THEN 0 ELSE greatest(0, 100 - CASE WHEN n < 1000 THEN 15 ELSE 0 END - CASE WHEN n < 300 THEN 35 ELSE 0 END - 35 * severe - 12 * (len(b) - severe)) END AS score FROM v),
g AS (SELECT *, CASE WHEN score < 35 OR list_contains(b, 'corrupted_ocr_or_mojibake') THEN 'REJECT' WHEN score < 55 THEN 'LOW' WHEN score < 80 THEN 'MEDIUM' ELSE 'HIGH' END AS label FROM w)
SELECT doc_id, md5(text) AS cleaned, navigation, repeated, empty, array_to_string(b, ',') AS signals, score::BIGINT AS score, label, CASE label WHEN 'REJECT' THEN 'reject' WHEN 'HIGH' THEN 'keep' ELSE 'manual_review' END AS action, ceil(n / 4.0::DOUBLE)::BIGINT AS tokens FROM g"""


def runs(name: str, lines: str, opens: str) -> str:
    """name(k, u, j, t): lines (k, part, pos, t), a run for each that opens one; u = part * 1000000 + run."""
    return f"""{name} AS (SELECT k, u, row_number() OVER (PARTITION BY k, u ORDER BY pos) AS j, t FROM (SELECT k, pos, t, part * 1000000 + sum(({opens})::INT) OVER (PARTITION BY k, part ORDER BY pos)::BIGINT AS u FROM {lines}))"""


def blocks(source: str) -> str:
    """SEG-03, SEG-04: bl(k, block_index, text) of source(doc_id, text)."""
    lines = filled("string_split(v, chr(10))")
    return f"""b0 AS MATERIALIZED (SELECT k, part, v, {lines} AS ls FROM (SELECT doc_id AS k, unnest(range(0, len(ps))) AS part, {STRIP.format("regexp_replace(unnest(ps), '[ \\t]+', ' ', 'g')")} AS v FROM (SELECT doc_id, regexp_split_to_array(text, '\\n\\s*\\n') AS ps FROM {source})) WHERE v <> ''),
b1 AS (SELECT k, part, unnest(range(0, len(ls))) AS pos, unnest(ls) AS t FROM b0 WHERE length(v) > 2600 AND len(ls) > 1),
{runs('b2', 'b1', is_heading('t') + " OR regexp_matches(t, '^\\d{1,3}[).:]\\s+\\S+')")},
{packed('b3', 'b2', 'length(t) + 1', 1801)},
b4 AS (SELECT k, 0 AS part, row_number() OVER (PARTITION BY k ORDER BY u, pack) AS pos, t FROM (SELECT k, part * 1000000 AS u, 0 AS pack, v AS t FROM b0 WHERE NOT (length(v) > 2600 AND len(ls) > 1) UNION ALL SELECT k, u, pack, array_to_string(own, chr(10)) FROM b3)),
{runs('b5', 'b4', is_heading('t'))},
{packed('b6', 'b5', 'length(t)', 2200)},
bl AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY u, pack) - 1 AS block_index, array_to_string(own, {NL}) AS text FROM b6)"""


MARKER = "(?i)^\\s*(?:\\d{1,4}|[ivxlcdm]{1,8}|=+\\s*page\\s+\\d+\\s*/\\s*\\d+\\s*=+|(?:page|стр\\.?|страница)\\s*\\d+)\\s*$"
CLEAN = f"""regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[' || chr(65279) || chr(173) || chr(8203) || ']', '', 'g'), chr(160), ' '), '[ \\t]+', ' ', 'g'), '\\n{{4,}}', repeat(chr(10), 3), 'g'), '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')"""
JOIN = "'(^|[^.!?;:)\\n])\\n(\\p{Ll})', '\\1 \\2', 'g'"


def share(pattern: str) -> str:
    return f"len(list_filter(ls, lambda x: regexp_matches(x, '{pattern}'))) / greatest(len(ls), 1)"


CLEAN_REPORT = f"""WITH RECURSIVE {DOCS}, n0 AS (SELECT doc_id, list_filter(string_split({CLEAN}, chr(10)), lambda x: NOT regexp_matches(x, '{MARKER}')) AS ls FROM d),
n1 AS (SELECT doc_id, trim(unnest(ls), ' ') AS line FROM n0), n2 AS (SELECT doc_id, line FROM n1 WHERE length(line) BETWEEN 5 AND 120 AND line NOT LIKE '%.' AND len(list_distinct(regexp_split_to_array(lower(line), '\\s+'))) >= 2 GROUP BY doc_id, line HAVING count(*) >= 4),
n3 AS (SELECT doc_id, array_to_string(list_filter(ls, lambda x: NOT list_contains(coalesce(gone, []), trim(x, ' '))), chr(10)) AS t FROM n0 LEFT JOIN (SELECT doc_id, list(line) AS gone FROM n2 GROUP BY doc_id) USING (doc_id)),
n4 AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]*\\n[ \\t]*', chr(10), 'g'), '-\\n(\\p{{Ll}})', '\\1', 'g'), {JOIN}), {JOIN}) AS t FROM n3),
n5 AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[~|]{{3,}}|_{{4,}}', ' ', 'g'), '\\.{{5,}}', ' ... ', 'g'), '[ \\t]+([,.;:!?])', '\\1', 'g'), '[ \\t]{{2,}}', ' ', 'g'), ' ') AS text FROM n4),
{blocks('n5')},
m AS (SELECT *, length(text) AS chars, substr(text, 1, 4000) AS t, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS ls, length(text) / greatest({n('[.!?]+')}, 1) AS av, {family('theory')} AS th, {', '.join(f'{family(k)} AS {k}' for k in ('bib', 'quest', 'test', 'exer', 'tocw', 'chap'))}, contains(text, '%') AS scoring, contains(text, '$') AS instr, contains(text, '&') AS clinical FROM bl),
e AS (SELECT *, {share(M.NUMBERED)} AS num, {share(M.CONTENTS)} AS toc, {share(M.REFERENCE)} AS ref, least(1.0::DOUBLE, th * 1000.0::DOUBLE / greatest(chars, 1) / 4 + CASE WHEN av BETWEEN 55 AND 260 THEN 0.12::DOUBLE ELSE 0 END) AS theory,
  least(1.0::DOUBLE, (1 - {n(chr(92) + 'p{L}', 't')} / greatest(length(t), 1)) * 0.65::DOUBLE + {n('�', 't')} * 0.02::DOUBLE + {n('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 's.,;:!?()' + chr(92) + '-]{4,}', 't')} * 0.03::DOUBLE) AS noise FROM m),
f AS (SELECT k, block_index, chars, text, CASE WHEN noise >= 0.72 AND chars < 1200 AND theory < 0.25 THEN 'reject_ocr_noise' WHEN (tocw >= 1 AND toc >= 0.25) OR toc >= 0.45 OR (chap >= 3 AND chars < 3500) THEN 'reject_toc' WHEN bib >= 2 AND (ref >= 0.35 OR bib * 1000 >= 5 * chars) AND theory < 0.45 THEN 'reject_bibliography'
  WHEN quest >= 2 AND num >= 0.22 AND theory < 0.5 THEN 'reject_questionnaire' WHEN test >= 4 AND num >= 0.2 AND theory < 0.5 THEN 'reject_test' WHEN scoring AND (num >= 0.12 OR quest >= 1 OR test >= 4) AND theory < 0.45 THEN 'reject_scoring_key' WHEN exer >= 3 AND num >= 0.12 AND instr AND NOT clinical AND theory < 0.5 THEN 'reject_exercise'
  WHEN theory >= 0.55 THEN 'keep_theory' WHEN theory >= 0.35 AND chars >= 450 THEN 'keep_clinical' WHEN chars >= 650 AND num < 0.25 AND noise < 0.6 THEN 'keep_narrative' ELSE 'review_unclear' END AS label FROM e),
g AS (SELECT *, label NOT LIKE 'reject%' AS keep, greatest(chars, 1) AS w, CASE label WHEN 'reject_ocr_noise' THEN 0.82 WHEN 'reject_toc' THEN 0.88 WHEN 'reject_bibliography' THEN 0.86 WHEN 'reject_questionnaire' THEN 0.84 WHEN 'reject_test' THEN 0.83 WHEN 'reject_scoring_key' THEN 0.80 WHEN 'reject_exercise' THEN 0.78
  WHEN 'keep_theory' THEN 0.82 WHEN 'keep_clinical' THEN 0.72 WHEN 'keep_narrative' THEN 0.68 ELSE 0.56 END::DOUBLE AS confidence FROM f),
h AS (SELECT k AS doc_id, count(*) AS blocks, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS rejected, count(*) FILTER (label = 'review_unclear') AS unclear, round(sum(confidence * w) / sum(w), 2) AS confidence, array_to_string(list_sort(list(DISTINCT label) FILTER (keep)), ',') AS labels_kept,
  array_to_string(list_sort(list(DISTINCT label) FILTER (NOT keep)), ',') AS labels_removed, coalesce(string_agg(text, {NL} ORDER BY block_index) FILTER (keep), '') AS cleaned FROM g GROUP BY k)
SELECT doc_id, coalesce(blocks, 0) AS blocks, coalesce(kept, 0) AS kept, coalesce(rejected, 0) AS rejected, coalesce(unclear, 0) AS unclear, coalesce(confidence, 0) AS confidence, coalesce(labels_kept, '') AS labels_kept, coalesce(labels_removed, '') AS labels_removed, length(text) AS chars_before, length(coalesce(cleaned, '')) AS chars_after,
  array_to_string(list_filter([CASE WHEN text = '' THEN 'empty_or_unreadable_source' END, CASE WHEN coalesce(unclear, 0) > 0 THEN 'review_unclear_blocks:' || unclear END, CASE WHEN text <> '' AND length(coalesce(cleaned, '')) < 0.35::DOUBLE * length(text) THEN 'large_removal_ratio_review_recommended' END], lambda x: x IS NOT NULL), ',') AS warnings, md5(coalesce(cleaned, '')) AS cleaned
FROM d LEFT JOIN h USING (doc_id)"""


def _begins(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(tail, '(?is){pattern}') THEN length(regexp_extract(tail, '(?is)^(.*?)(?:{pattern})', 1)) + 1 ELSE 0 END"


PARAGRAPHS = filled("regexp_split_to_array({}, '\\n\\s*\\n')")
OPENS = "(?i)((?:глава|chapter|part|section|раздел|часть)\\s+\\d{1,3}[.:]?\\s+)"


def stabilized(named: str) -> str:
    """PIP-02: z(doc_id, filename, .., text), a stabilised row for each of f(doc_id, text, filename); named: the expressions up to f."""
    stats = lambda t, p: f"len({p}) AS {t}_n, round(length({t}) / greatest(len({p}), 1), 1) AS {t}_average, len({p}) <= 2 AND length({t}) > 10000 AS {t}_large"
    ready = lambda large, average, tail: f"round(greatest(0, least(1, 1.0::DOUBLE - CASE WHEN {large} THEN 0.35::DOUBLE ELSE 0 END - CASE WHEN {average} > 2400 THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN {tail} THEN 0.04::DOUBLE ELSE 0 END - CASE WHEN duplicate_of IS NOT NULL THEN 0.25::DOUBLE ELSE 0 END - CASE WHEN category = 'form_card' THEN 0.2::DOUBLE ELSE 0 END)), 2)"
    markers = ", ".join(f"CASE WHEN contains(low, '{m}') THEN '{k}' END" for k, m in stabilize.FORM_MARKERS.items())
    theory = " + ".join(n(p, "low") for p in stabilize.THEORY)
    return f"""{named}, z0 AS MATERIALIZED (SELECT doc_id, filename, text, ps, {stats('text', 'ps')} FROM (SELECT doc_id, filename, text, {PARAGRAPHS.format('text')} AS ps FROM f)),
p0 AS MATERIALIZED (SELECT k, part, unnest(range(0, len(xs))) AS piece, unnest(xs) AS t FROM (SELECT k, part, CASE WHEN length(t) <= 2400 THEN [t] ELSE {filled(f"string_split(regexp_replace(t, '{OPENS}', chr(1) || '{chr(92)}1', 'g'), chr(1))")} END AS xs FROM (SELECT doc_id AS k, unnest(range(0, len(ps))) AS part, unnest(ps) AS t FROM z0 WHERE text_large))),
p1 AS (SELECT k, part * 10000 + piece AS part, unnest(range(0, len(ss))) AS pos, unnest(ss) AS t FROM (SELECT k, part, piece, {filled(SENTENCES.format('t'))} AS ss FROM p0 WHERE length(t) > 2400)),
{runs('p2', 'p1', "regexp_matches(t, '^" + chr(92) + "d{1,2}" + chr(92) + "." + chr(92) + "s+[A-ZА-ЯЁ]')")},
{packed('p3', 'p2', 'length(t) + 1', 1401)},
p4 AS (SELECT k, (part * 10000 + piece) * 1000000 AS u, 0 AS pack, t, false AS cut FROM p0 WHERE length(t) <= 2400 UNION ALL SELECT k, u, pack, array_to_string(own, ' '), true FROM p3),
p5 AS (SELECT k, string_agg(t, {NL} ORDER BY u, pack) AS new, count(*) FILTER (cut) - count(DISTINCT u // 1000000) FILTER (cut) AS cuts, count(*) AS parts FROM p4 GROUP BY k),
z1 AS (SELECT z0.*, CASE WHEN text_large THEN coalesce(new, '') ELSE text END AS whole, CASE WHEN text_large THEN coalesce(cuts + greatest(0, parts - len(ps)), 0) ELSE 0 END AS restore_splits FROM z0 LEFT JOIN p5 ON p5.k = doc_id),
z2 AS (SELECT *, greatest(0, length(whole) - 25000) AS s, substr(whole, greatest(0, length(whole) - 25000) + 1) AS tail FROM z1),
z3 AS (SELECT *, {_begins(stabilize.PUBLISHER)} AS pub, {_begins(stabilize.BIBLIOGRAPHY)} AS bib, {_begins(stabilize.CONTENTS)} AS toc FROM z2),
z4 AS (SELECT *, list_min(list_filter([CASE WHEN pub > 0 AND pub - 1 > length(tail) * 0.45::DOUBLE THEN {{'at': pub, 'n': 0, 'reason': 'publisher_tail'}} END, CASE WHEN bib > 0 AND bib - 1 > length(tail) * 0.35::DOUBLE AND {n('(?i)' + stabilize.REFERENCES, 'substr(tail, bib)')} >= 4 THEN {{'at': bib, 'n': 1, 'reason': 'bibliography_tail'}} END,
  CASE WHEN toc > 0 AND toc - 1 > length(tail) * 0.4::DOUBLE AND {n('(?i)' + stabilize.CHAPTER, 'substr(tail, toc)')} >= 3 THEN {{'at': toc, 'n': 2, 'reason': 'trailing_toc'}} END], lambda x: x IS NOT NULL)) AS first FROM z3),
z5 AS (SELECT *, CASE WHEN first IS NOT NULL AND length(whole) - s - first.at + 1 >= 300 THEN length(whole) - s - first.at + 1 ELSE 0 END AS tail_removed FROM z4),
z6 AS (SELECT *, CASE WHEN tail_removed > 0 THEN rtrim(substr(whole, 1, length(whole) - tail_removed), ' ') ELSE whole END AS new FROM z5),
z7 AS (SELECT *, {stats('new', PARAGRAPHS.format('new'))}, lower(filename) || chr(10) || lower(substr(new, 1, 30000)) AS low FROM z6),
z8 AS (SELECT *, list_filter([{markers}], lambda x: x IS NOT NULL) AS reasons FROM z7),
z9 AS (SELECT *, greatest(0, round(least(1.0::DOUBLE, len(reasons) * 0.12::DOUBLE + least({n('[?]', 'low')}, 12) * 0.015::DOUBLE + least({n(':', 'low')} / greatest(length(low) / 1000.0::DOUBLE, 1), 10) * 0.02::DOUBLE) - CASE WHEN {theory} >= 8 AND length(new) > 20000 THEN 0.25::DOUBLE ELSE 0 END, 2)) AS form_score FROM z8),
y0 AS (SELECT doc_id, filename, regexp_replace(filename, '(.)(?:\\.ocr\\.raw\\.cleaned\\.txt|\\.ocr\\.cleaned\\.cleaned\\.txt|\\.cleaned\\.cleaned\\.txt|\\.cleaned\\.txt|\\.[^.]*)$', '\\1') AS base, length(text) AS chars, substr(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]+', ' ', 'g'), ' '), 1, 200000) AS mark,
  round(greatest(0, 1.0::DOUBLE - CASE WHEN text_large THEN 0.25::DOUBLE ELSE 0 END - CASE WHEN contains(lower(substr(text, 1, 100)), 'ocr.raw') THEN 0.05::DOUBLE ELSE 0 END - least(0.2::DOUBLE, {n('�')} * 0.01::DOUBLE) - least(0.15::DOUBLE, {n('[=_|]{4,}', 'substr(text, 1, 100000)')} * 0.01::DOUBLE)), 3) AS quality,
  list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM z0),
y1 AS MATERIALIZED (SELECT doc_id, base, mark, row_number() OVER (PARTITION BY base ORDER BY -quality, contains(filename, 'ocr.raw'), -chars, doc_id) AS place, CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) END AS g FROM y0),
y2 AS (SELECT a.doc_id, b.doc_id AS duplicate_of, a.mark = b.mark AS same, len(list_intersect(a.g, b.g)) AS shared, len(a.g) + len(b.g) AS total FROM y1 a JOIN y1 b ON a.base = b.base AND a.place > 1 AND b.place = 1),
y3 AS (SELECT doc_id, duplicate_of, same, coalesce(shared / nullif(total - shared, 0), 0)::DOUBLE AS similarity FROM y2), y AS (SELECT * FROM y3 WHERE same OR similarity >= 0.8),
x0 AS (SELECT z9.*, duplicate_of, similarity, CASE WHEN form_score >= 0.42 AND length(new) < 80000 THEN 'form_card' ELSE 'explanatory_narrative' END AS category FROM z9 LEFT JOIN y USING (doc_id)),
z AS MATERIALIZED (SELECT doc_id, filename, length(text) AS chars_before, length(new) AS chars_after, restore_splits, tail_removed, CASE WHEN tail_removed > 0 THEN first.reason ELSE '' END AS tail_reason, category AS logical_category, form_score, reasons AS form_reasons, CASE WHEN duplicate_of IS NULL THEN 'canonical_or_unique' ELSE 'duplicate_candidate' END AS duplicate_status, duplicate_of, similarity,
  {ready('text_large', 'text_average', 'false')} AS readiness_before, {ready('new_large', 'new_average', 'tail_removed > 0')} AS readiness_after, CASE WHEN category = 'form_card' THEN 'cleaned_corpus/forms/' ELSE 'cleaned_corpus/good/' END || filename AS planned_output,
  CASE WHEN category = 'form_card' THEN 0.0 WHEN tail_removed > 0 OR restore_splits > 0 THEN 1.05 ELSE 1.0 END::DOUBLE AS retrieval_weight, new AS text FROM x0)"""


def doc_stabilize(named: str) -> str:
    return f"WITH RECURSIVE {stabilized(named)} SELECT * EXCLUDE (text, form_reasons), array_to_string(form_reasons, ',') AS form_reasons, md5(text) AS stabilized_text FROM z"


def stabilize_summary(named: str) -> str:
    return f"""WITH RECURSIVE {stabilized(named)} SELECT count(*) AS files, count(*) FILTER (restore_splits > 0) AS restores, count(*) FILTER (duplicate_of IS NOT NULL) AS duplicates, count(*) FILTER (logical_category = 'form_card') AS forms, count(*) FILTER (tail_removed > 0) AS tails,
  sum(chars_before)::BIGINT AS chars_before, sum(chars_after)::BIGINT AS chars_after, round(avg(readiness_before), 3) AS readiness_before, round(avg(readiness_after), 3) AS readiness_after FROM z"""


def chunk_job(named: str) -> str:
    """PIP-03 over documents that FLT-13 leaves in."""
    return f"""WITH RECURSIVE {stabilized(named)}, src AS (SELECT doc_id, text FROM z WHERE logical_category <> 'form_card' AND duplicate_of IS NULL), {chunk_sql.semantic('src', 'doc_id', chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n')}
SELECT sha1(filename || '[' || first_paragraph || ',' || last_paragraph || ']' || trim(lower(regexp_replace(chunk, '\\s+', ' ', 'g')), ' ')) AS chunk_id, md5(chunk) AS text, 'test' AS namespace, 'en' AS language, retrieval_weight, filename AS source_file, filename AS canonical_source, logical_category, duplicate_status, first_paragraph, last_paragraph, chunk_index,
  tokens AS token_estimate, length(chunk) AS char_count, readiness_before, readiness_after, restore_splits > 0 AS restored, tail_removed > 0 AS tail_cut, continuity, redundancy, tokens > 1150 AS oversized, (tokens < 350 AND first_paragraph = last_paragraph)::INT AS orphan_paragraphs
FROM chunks JOIN z ON z.doc_id = chunks.k"""
