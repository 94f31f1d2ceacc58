"""SQL of the packers, as chains of common table expressions for WITH RECURSIVE: one step of recursion a paragraph."""

from __future__ import annotations

from textloom.operators.segment import BRIDGES, HARD, LEAST, MOST, ORPHAN, OVERLAP, SHIFTS, WANTED

STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
SENTENCES = "string_split(regexp_replace({}, '([.!?])\\s+([A-ZА-ЯЁ])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


def filled(parts: str) -> str:
    """The parts of a list that aren't blank, stripped."""
    return f"list_filter(list_transform({parts}, lambda p: {STRIP.format('p')}), lambda p: p <> '')"


def words(t: str) -> str:
    return f"len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda y: y <> ''))"


def tokens(n_words: str, chars: str) -> str:
    return f"greatest({n_words}, round(greatest({chars}, 1) / 4.2::DOUBLE)::BIGINT)"


def word_end(pattern: str) -> str:
    """A word's end is one of any script."""
    return pattern.replace("\\b", "(?:[^\\p{L}\\p{N}_]|$)")


def of(places: str, column: str) -> str:
    return f"list_transform({places}, lambda x: {column}[x])"


def joined_tokens(places: str) -> str:
    """Tokens of paragraphs joined by blank lines."""
    return tokens(f"list_sum({of(places, 'w')})", f"list_sum({of(places, 'c')}) + 2 * (len({places}) - 1)")


def packed(name: str, parts: str, size: str, limit: int) -> str:
    """name(k, u, pack, own): runs of parts (k, u, j, t), j from 1 on, as many in a pack as the limit allows."""
    return f"""{name}_n AS MATERIALIZED (SELECT k, u, j, t, {size} AS n FROM {parts}),
{name}_r AS (
  SELECT k, u, j, 0 AS pack, n AS have FROM {name}_n WHERE j = 1
  UNION ALL SELECT r.k, r.u, r.j + 1, CASE WHEN r.have + x.n > {limit} THEN r.pack + 1 ELSE r.pack END, CASE WHEN r.have + x.n > {limit} THEN x.n ELSE r.have + x.n END FROM {name}_r r JOIN {name}_n x ON x.k = r.k AND x.u = r.u AND x.j = r.j + 1
), {name} AS MATERIALIZED (SELECT r.k, r.u, r.pack, list(x.t ORDER BY x.j) AS own FROM {name}_r r JOIN {name}_n x USING (k, u, j) GROUP BY r.k, r.u, r.pack)"""


def semantic(source: str, key: str, separator: str) -> str:
    """CHK-01..03, SEG-06, FLT-03..05, MSR-19/20: chunks(k, chunk_index, chunk, first_paragraph, last_paragraph, tokens, continuity, redundancy) of source(key, text)."""
    label = """CASE WHEN length(t) <= 140 AND regexp_matches(lower(t), '^(?:глава|раздел|часть|chapter|section)\\s+\\d+') THEN 'heading' WHEN length(t) <= 120 AND t = upper(t) AND len(regexp_extract_all(t, '[A-Za-zА-Яа-яЁё]')) >= 5 THEN 'heading'
    WHEN regexp_matches(t, '^(?:\\d+[).:]|[-*])\\s+\\S+') THEN 'list_like' WHEN regexp_matches(lower(t), 'например|пример|случай|пациент|клиент') THEN 'example_or_clinical' ELSE 'narrative' END"""
    bound = f"((x.label = 'heading' AND m.h >= {LEAST}) OR (x.label = 'list_like' AND m.h >= {WANTED}) OR (m.h >= {WANTED} AND regexp_matches(x.t, '^\\p{{Lu}}')))"
    cut = f"""CASE WHEN b > a AND list_sum(n[a:b]) > {MOST} THEN list_min(list_transform(list_filter(range(a + 1, b + 1), lambda x: list_sum(n[a:x - 1]) >= {LEAST} AND NOT br[x]),
    lambda x: {{'r': CASE WHEN lab[x] IN ('heading', 'list_like', 'example_or_clinical') THEN 0 ELSE 1 END, 'd': abs(list_sum(n[a:x - 1]) - {WANTED}), 'x': x}})).x END"""
    share = lambda a, b: f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / least(len({a}), len({b})) ELSE 0 END"
    vocabulary = lambda p: f"list_distinct(flatten({of(p, 'ws')}))"
    return f"""s0 AS MATERIALIZED (SELECT k, unnest(range(0, len(ps))) AS idx, unnest(ps) AS t FROM (SELECT {key} AS k, {filled(f"regexp_split_to_array(text, '{separator}')")} AS ps FROM {source})),
s1 AS MATERIALIZED (SELECT k, idx, t, {label} AS label, {tokens(words('t'), 'length(t)')} AS n FROM s0),
s2 AS (SELECT k, idx AS u, unnest(range(1, len(ss) + 1)) AS j, unnest(ss) AS t FROM (SELECT k, idx, {filled(SENTENCES.format('t'))} AS ss FROM s1 WHERE n > {MOST})),
{packed('s3', 's2', tokens(words('t'), 'length(t)'), MOST)},
s4 AS (SELECT k, idx, 0 AS sub, t, label FROM s1 WHERE n <= {MOST} UNION ALL SELECT s3.k, s3.u, s3.pack, array_to_string(s3.own, ' '), s1.label || '_split_' || s3.pack FROM s3 JOIN s1 ON s1.k = s3.k AND s1.idx = s3.u),
q AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY idx, sub) AS i, idx, t, label, {words('t')} AS w, length(t) AS c, {tokens(words('t'), 'length(t)')} AS n, regexp_matches(lower(t), '^{word_end(BRIDGES)}') AS br,
  label = 'heading' OR regexp_matches(lower(t), '^(?:{word_end(SHIFTS)})') AS sh, list_distinct(regexp_extract_all(lower(t), '[A-Za-zА-Яа-яЁё]{{4,}}')) AS ws, label <> 'heading' AND {tokens(words('t'), 'length(t)')} <= {OVERLAP} AS ok FROM s4),
m AS (
  SELECT DISTINCT k, 0::BIGINT AS i, 1::BIGINT AS a, false AS l, 0::BIGINT AS h, false AS ok, 0::BIGINT AS n, []::STRUCT(a BIGINT, b BIGINT, l BOOLEAN)[] AS fs FROM q
  UNION ALL SELECT k, i + 1, CASE WHEN h1 >= {MOST} THEN CASE WHEN ok THEN i + 1 ELSE i + 2 END ELSE a1 END, CASE WHEN h1 >= {MOST} THEN ok ELSE l1 END, CASE WHEN h1 >= {MOST} THEN CASE WHEN ok THEN n ELSE 0 END ELSE h1 END, ok, n,
    list_filter([CASE WHEN fl THEN {{'a': a, 'b': i, 'l': l}} END, CASE WHEN h1 >= {MOST} THEN {{'a': a1, 'b': i + 1, 'l': l1}} END], lambda y: y IS NOT NULL)
  FROM (SELECT k, i, a, l, fl, ok, n, CASE WHEN fl THEN CASE WHEN lead THEN i ELSE i + 1 END ELSE a END AS a1, CASE WHEN fl THEN lead ELSE l END AS l1, (CASE WHEN fl THEN CASE WHEN lead THEN pn ELSE 0 END ELSE h END) + n AS h1
    FROM (SELECT m.k, m.i, m.a, m.l, m.h, m.ok AS lead, m.n AS pn, x.ok, x.n, m.a <= m.i AND {bound} AS fl FROM m JOIN q x ON x.k = m.k AND x.i = m.i + 1))
),
g0 AS (SELECT k, i, unnest(fs) AS f FROM m UNION ALL SELECT k, i + 1, {{'a': a, 'b': i, 'l': l}} FROM (SELECT *, max(i) OVER (PARTITION BY k) AS top FROM m) WHERE i = top AND a <= i),
ar AS MATERIALIZED (SELECT k, {', '.join(f'list({x} ORDER BY i) AS {y}' for x, y in (('n', 'n'), ('br', 'br'), ('label', 'lab'), ('w', 'w'), ('c', 'c'), ('ws', 'ws'), ('sh', 'sh'), ('idx', 'idx'), ('t', 't')))} FROM q GROUP BY k),
g1 AS (
  SELECT k, o, a, b, a AS start, l, {cut} AS cut FROM (SELECT k, i * 2 AS o, f.a AS a, f.b AS b, f.l AS l FROM g0) JOIN ar USING (k)
  UNION ALL SELECT k, o, a, b, start, l, {cut} FROM (SELECT k, o, unnest([a, cut]) AS a, unnest([cut - 1, b]) AS b, start, l FROM g1 WHERE cut IS NOT NULL) JOIN ar USING (k)
),
g2 AS MATERIALIZED (SELECT k, g, p, lead, {joined_tokens('p')} AS tk, sh[p[1]] AS sh, {vocabulary('p')} AS ws, len(p) = 1 AND n[p[1]] < 280 AND br[p[1]] AND NOT regexp_matches(t[p[1]], '[.!?:»"]$') AS stub
  FROM (SELECT k, row_number() OVER (PARTITION BY k ORDER BY o, a) AS g, range(a, b + 1) AS p, CASE WHEN l AND a = start THEN [a] ELSE [] END AS lead FROM g1 WHERE cut IS NULL) JOIN ar USING (k)),
fold AS (
  SELECT DISTINCT k, 0::BIGINT AS g, 0::BIGINT AS nd, []::BIGINT[] AS p, []::BIGINT[] AS lead, []::BIGINT[] AS wp, []::BIGINT[] AS wl FROM g2
  UNION ALL SELECT k, g + 1, nd + CASE WHEN act IN ('join', 'wait') THEN 0 ELSE 1 END, CASE act WHEN 'take' THEN list_concat(wp, xp) WHEN 'push' THEN xp WHEN 'join' THEN list_concat(p, xp) ELSE p END,
    CASE act WHEN 'take' THEN list_concat(wl, xl) WHEN 'push' THEN xl WHEN 'join' THEN list_concat(lead, xl) ELSE lead END, CASE WHEN act = 'wait' THEN xp ELSE [] END, CASE WHEN act = 'wait' THEN xl ELSE [] END
  FROM (SELECT f.k, f.g, f.nd, f.p, f.lead, f.wp, f.wl, x.p AS xp, x.lead AS xl, CASE WHEN len(f.wp) > 0 THEN 'take' WHEN NOT (x.tk < {ORPHAN} OR x.stub) THEN 'push'
      WHEN f.nd > 0 AND {joined_tokens('f.p')} + x.tk <= {MOST} AND NOT x.sh AND (y.k IS NULL OR {share(f"list_distinct(flatten({of('f.p', 'vocabulary')}))", 'x.ws')} >= {share('x.ws', 'y.ws')}) THEN 'join'
      WHEN y.k IS NOT NULL AND x.tk + y.tk <= {MOST} AND NOT y.sh THEN 'wait' ELSE 'push' END AS act
    FROM fold f JOIN g2 x ON x.k = f.k AND x.g = f.g + 1 LEFT JOIN g2 y ON y.k = x.k AND y.g = x.g + 1 JOIN (SELECT k, w, c, ws AS vocabulary FROM ar) ar ON ar.k = f.k)
),
h AS (SELECT k, nd, arg_max(p, g) AS p, arg_max(lead, g) AS lead FROM fold WHERE nd > 0 GROUP BY k, nd),
chunks AS MATERIALIZED (SELECT k, CASE WHEN tk > {HARD} AND len(p) > 1 THEN -1 ELSE nd - 1 END AS chunk_index, array_to_string(own, chr(10) || chr(10)) AS chunk, ids[1] AS first_paragraph, ids[len(ids)] AS last_paragraph, tk AS tokens,
  round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.82::DOUBLE + 0.08::DOUBLE * (ls[1] = 'heading' AND len(ls) > 1)::INT - 0.08::DOUBLE * (len(list_distinct(ls)) > 3)::INT - 0.1::DOUBLE * (len(ls) >= 4 AND len(list_filter(ls, lambda x: x = 'narrative')) >= 4 AND tk > {WANTED})::INT
    - 0.12::DOUBLE * (tk < {LEAST})::INT - 0.18::DOUBLE * (tk > {MOST})::INT - 0.22::DOUBLE * (tk > {HARD})::INT)), 2) AS continuity,
  printf('%.3f', coalesce(list_sum(list_transform(list_filter(p, lambda x: list_contains(lids, idx[x])), lambda x: n[x])), 0) / greatest(tk, 1)::DOUBLE)::DOUBLE AS redundancy
  FROM (SELECT k, nd, p, idx, n, {joined_tokens('p')} AS tk, {of('p', 'lab')} AS ls, {of('p', 'idx')} AS ids, {of('p', 't')} AS own, {of('lead', 'idx')} AS lids FROM h JOIN ar USING (k)))"""
