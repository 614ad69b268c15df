"""The catalogue's queries as DuckDB SQL, built from common table expressions."""

from __future__ import annotations

WS = r"[ \t\n\r\f\x0B]"
EDGE = r"[ \t\n\r\f\x0B\"''“”‘’*_(){}\[\]<>-]"
LABEL = r"[A-Za-z][A-Za-z0-9 _.''’-]{0,48}"
SEP = ",.;:!?—–"
NL = "chr(10)"

DOCS = "docs AS (SELECT doc_id, text FROM documents)"
TALKS = f"docs AS (SELECT conv_id AS doc_id, string_agg('# ' || role || {NL} || {NL} || coalesce(text, ''), {NL} || {NL} ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"

NOTES = f"docs AS (SELECT (conv_id // 3)::BIGINT AS doc_id, string_agg(coalesce(text, ''), {NL} ORDER BY conv_id, turn) AS text FROM conversations GROUP BY ALL)"
CHATS = f"docs AS (SELECT (conv_id // 50)::BIGINT AS doc_id, string_agg(coalesce(text, ''), {NL} ORDER BY conv_id, turn) AS text FROM conversations GROUP BY ALL)"
BOOKS = f"docs AS (SELECT (conv_id // 8)::BIGINT AS doc_id, string_agg('# ' || role || {NL} || {NL} || coalesce(text, ''), {NL} || {NL} ORDER BY conv_id, turn) AS text FROM conversations GROUP BY ALL)"


def sub(x, pattern, to=""):
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def strip(x):
    return sub(sub(x, rf"\A{WS}+"), rf"{WS}+\z")


def words(x):
    return rf"len(regexp_extract_all(coalesce({x}, ''), '[\w''-]*\w[\w''-]*'))"


LINES = rf"""
front AS (SELECT doc_id, text, CASE WHEN starts_with(text, '---' || {NL}) AND instr(substring(text, 5), {NL} || '---' || {NL}) > 0
  THEN instr(substring(text, 5), {NL} || '---' || {NL}) + 8 ELSE 0 END AS front FROM docs WHERE text IS NOT NULL),
split_lines AS (SELECT doc_id, front, unnest(arr) AS raw, generate_subscripts(arr, 1) AS line FROM (SELECT doc_id, front, string_split(substring(text, front + 1), {NL}) AS arr FROM front)),
lines AS (SELECT doc_id, line, raw, {strip("raw")} AS stripped,
  front + coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM split_lines)"""

PARAGRAPHS = rf"""{LINES},
marked AS (SELECT *, regexp_matches(stripped, '\A#{{1,6}}{WS}+') AS heading FROM lines),
sectioned AS (SELECT *, coalesce(last_value(CASE WHEN heading THEN {strip(sub("stripped", rf"\A#{{1,6}}{WS}+"))} END IGNORE NULLS) OVER w, '(preamble)') AS section,
  sum((heading OR stripped IN ('---', ''))::INT) OVER w AS part FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
parts AS (SELECT doc_id, part, min(section) AS section, min(line) AS start_line, max(line) AS end_line, string_agg(stripped, {NL} ORDER BY line) AS text,
  {strip(f"string_agg(raw, {NL} ORDER BY line)")} AS source, arg_min(start + length(raw) - length({sub("raw", rf"\A{WS}+")}), line) AS source_start
  FROM sectioned WHERE NOT heading AND stripped NOT IN ('---', '') GROUP BY doc_id, part),
paragraphs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS para_index, section, start_line, end_line, text, source, source_start FROM parts)"""

STOP = "['a','an','the','and','or','but','if','in','on','at','to','for','of','is','are','was','were','be','been','being','have','has','had','do','does','did','will','would','could','should','may','might','shall','can','i','you','he','she','it','we','they','this','that','these','those']"
TOKENS = r"list_transform(regexp_extract_all({}, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*'), lambda t: lower(t))"


def names(labels):
    return f"list_filter(list_distinct(flatten(list_transform({labels}, lambda p: {TOKENS.format(sub('p', '[\"' + chr(39) * 2 + ']'))}))), lambda t: NOT list_contains({STOP}, t))"


SPEAKERS = rf"regexp_extract_all(text, '(?:\A|\n)[ \t\r\f\x0B]*({LABEL}):[ \t\f\x0B]+[^ \t\n\r\f\x0B]', 1)"
CHARACTERS = rf"regexp_extract_all(substring(text, 1, front), '(?:\A|\n)[ \t\r\f\x0B]*characters:([^\n]*)', 1)"

FRAGMENTS = rf"""{PARAGRAPHS},
excluded AS (SELECT doc_id, list_concat({names(SPEAKERS)}, {names(CHARACTERS)}) AS excluded FROM front),
cut AS (SELECT doc_id, para_index, section, start_line, source_start, unnest(arr) AS piece, generate_subscripts(arr, 1) AS pos FROM (SELECT *, regexp_extract_all(source, '[^{SEP}]+|[{SEP}]+') AS arr FROM paragraphs)),
placed AS (SELECT *, source_start + coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, para_index ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  left(lead(piece) OVER (PARTITION BY doc_id, para_index ORDER BY pos), 1) AS next_char FROM cut),
cleaned AS (SELECT *, trim({sub(sub(sub("piece", rf"\A{EDGE}+"), rf"{EDGE}+\z"), rf"{WS}+", " ")}) AS text,
  start + length(piece) - length({sub("piece", rf"\A{EDGE}+")}) AS s0, start + length({sub("piece", rf"{EDGE}+\z")}) AS s1 FROM placed WHERE NOT regexp_matches(piece, '\A[{SEP}]')),
tokened AS (SELECT c.*, list_filter({TOKENS.format("c.text")}, lambda t: NOT list_contains(e.excluded, t)) AS tokens FROM cleaned c JOIN excluded e USING (doc_id)
  WHERE c.text <> '' AND NOT (regexp_matches(c.text, '\A{LABEL}\z') AND coalesce(next_char = ':', false))),
fragments AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY para_index, pos) - 1)::INT AS idx, para_index, section, start_line, text, s0 AS source_start, s1 AS source_end,
  regexp_matches(regexp_extract(text, '[A-Za-z]'), '^[A-Z]$') AS starts_capitalized, tokens FROM tokened WHERE len(tokens) >= 3)"""


def grams(tokens, n, sep="' '"):
    return f"list_transform(range(1, len({tokens}) - {n} + 2), lambda i: array_to_string(list_slice({tokens}, i, i + {n} - 1), {sep}))"


PHRASES = f"list_concat({grams('tokens', 2)}, {grams('tokens', 3)}, {grams('tokens', 4)})"

FLAGS = f"""{FRAGMENTS},
grammed AS (SELECT doc_id, idx, tokens, len(tokens) AS n, len(list_distinct(tokens)) AS d, {PHRASES} AS g FROM fragments),
repeats AS (SELECT doc_id, idx, sum(k - 1) AS windows, list(p ORDER BY p) AS signatures FROM (SELECT doc_id, idx, p, count(*) AS k FROM (SELECT doc_id, idx, unnest(g) AS p FROM grammed) GROUP BY ALL) WHERE k > 1 GROUP BY ALL),
tops AS (SELECT doc_id, idx, max(k) AS top FROM (SELECT doc_id, idx, t, count(*) AS k FROM (SELECT doc_id, idx, unnest(tokens) AS t FROM grammed) GROUP BY ALL) GROUP BY ALL),
measured AS (SELECT g.doc_id, g.idx, n, coalesce(windows, 0) AS repeated_windows, coalesce(signatures, []) AS signatures, n - d AS repeated_mass,
  top / greatest(1, n)::DOUBLE AS dominant_share, d / greatest(1, n)::DOUBLE AS unique_ratio, coalesce(windows, 0) / greatest(1, n - 1)::DOUBLE AS repeat_density
  FROM grammed g JOIN tops t USING (doc_id, idx) LEFT JOIN repeats r USING (doc_id, idx)),
reasoned AS (SELECT *, list_filter([CASE WHEN len(signatures) > 0 THEN 'internal-window-repeat' END, CASE WHEN repeated_mass >= 2 THEN 'token-reuse' END, CASE WHEN repeat_density >= 0.12e0 THEN 'looped-phrasing' END,
  CASE WHEN unique_ratio <= 0.72e0 AND n >= 6 THEN 'low-diversity' END, CASE WHEN dominant_share >= 0.22e0 AND n >= 8 THEN 'dominant-token' END], lambda r: r IS NOT NULL) AS reasons,
  repeated_mass * 0.7e0 + repeat_density * 2.3e0 + (1.0e0 - unique_ratio) * 1.3e0 + dominant_share * 0.8e0 AS score FROM measured),
flags AS (SELECT * FROM reasoned WHERE len(reasons) > 0)"""


def pairs(radius, cap=180):
    return f"""{FRAGMENTS},
token_rows AS (SELECT doc_id, idx, para_index, unnest(list_distinct(tokens)) AS token FROM fragments),
postings AS (SELECT doc_id, token, count(*) AS n FROM token_rows GROUP BY ALL),
usable AS (SELECT t.* FROM token_rows t JOIN postings p USING (doc_id, token) WHERE p.n <= {cap}),
pairs AS (SELECT DISTINCT x.doc_id, x.idx AS a, y.idx AS b, abs(x.para_index - y.para_index) AS distance FROM usable x JOIN usable y ON x.doc_id = y.doc_id AND x.token = y.token AND x.idx < y.idx WHERE abs(x.para_index - y.para_index) <= {radius})"""


def jaccard(a, b):
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0e0 ELSE {both} / (len({a}) + len({b}) - {both})::DOUBLE END"


# one row of the table a token of x; a cell is the longest of its neighbours
LCS = """list_last(list_reduce(x.tokens, lambda row, t: list_reduce(list_transform(y.tokens, lambda u, j: CASE WHEN u = t THEN row[j] + 1 ELSE row[j + 1] END),
  lambda acc, c: list_append(acc, greatest(c, list_last(acc))), [0::BIGINT]), list_transform(range(0, len(y.tokens) + 1), lambda k: 0::BIGINT)))"""


SCORED = f"""sets AS (SELECT doc_id, idx, tokens, list_distinct(tokens) AS s, list_distinct({grams("tokens", 2)}) AS two, list_distinct({grams("tokens", 3)}) AS three FROM fragments),
compared AS (SELECT p.*, len(list_intersect(x.s, y.s)) AS shared, {jaccard("x.s", "y.s")} AS overlap, {jaccard("x.two", "y.two")} AS bigram, {jaccard("x.three", "y.three")} AS trigram,
  1.0e0 - abs(len(x.tokens) - len(y.tokens)) / greatest(len(x.tokens), len(y.tokens))::DOUBLE AS size, 2 * {LCS} / (len(x.tokens) + len(y.tokens))::DOUBLE AS seq,
  (list_contains(x.s, 'i') AND list_contains(y.s, 'you')) OR (list_contains(x.s, 'you') AND list_contains(y.s, 'i')) AS swap, x.s AS set_a, y.s AS set_b
  FROM pairs p JOIN sets x ON x.doc_id = p.doc_id AND x.idx = p.a JOIN sets y ON y.doc_id = p.doc_id AND y.idx = p.b),
scored AS (SELECT *, swap AND overlap >= 0.35e0 AS exchange, 0.38e0 * overlap + 0.20e0 * seq + 0.16e0 * bigram + 0.08e0 * trigram + 0.18e0 * size AS score FROM compared)"""


def similar(radius):
    return f"{pairs(radius)},\n{SCORED}"


def base_matched(radius=12, least=0.2):
    return f"""{similar(radius)},
good AS (SELECT *, greatest(0.0e0, score - CASE WHEN exchange THEN 0.12e0 ELSE 0.0e0 END) / (1 + distance) AS weighted FROM scored WHERE (shared >= 1 OR bigram > 0) AND score >= {least}e0),
matches AS (SELECT doc_id, a AS idx, b AS other, distance, shared, score, weighted, set_b AS other_tokens FROM good UNION ALL SELECT doc_id, b, a, distance, shared, score, weighted, set_a FROM good)"""


def matched(radius=12, growth=3, least=0.2, cap=180):
    """Matches after the frontier walk: a step of `walk` is a fragment's state before a round
    (what it found, the tokens it knows); it goes on while its best matches bring in tokens
    whose fragments it hasn't found. Whatever is accepted shares a token, so `good` holds
    every pair that the walk may find."""
    return f"""{FRAGMENTS},
token_rows AS MATERIALIZED (SELECT doc_id, idx, para_index, unnest(list_distinct(tokens)) AS token FROM fragments),
pairs AS (SELECT DISTINCT x.doc_id, x.idx AS a, y.idx AS b, abs(x.para_index - y.para_index) AS distance FROM token_rows x JOIN token_rows y ON x.doc_id = y.doc_id AND x.token = y.token AND x.idx < y.idx WHERE abs(x.para_index - y.para_index) <= {radius * max(1, growth)}),
{SCORED},
both_ways AS (SELECT *, greatest(0.0e0, score - CASE WHEN exchange THEN 0.12e0 ELSE 0.0e0 END) / (1 + distance) AS weighted FROM scored WHERE (shared >= 1 OR bigram > 0) AND score >= {least}e0),
good AS MATERIALIZED (SELECT doc_id, a AS idx, b AS other, distance, shared, score, weighted, set_b AS other_tokens FROM both_ways UNION ALL SELECT doc_id, b, a, distance, shared, score, weighted, set_a FROM both_ways),
usable AS MATERIALIZED (SELECT t.* FROM token_rows t JOIN (SELECT doc_id, token FROM token_rows GROUP BY ALL HAVING count(*) <= {cap}) p USING (doc_id, token)),
first_found AS (SELECT g.doc_id, g.idx, list(DISTINCT g.other) AS found FROM good g JOIN usable x ON x.doc_id = g.doc_id AND x.idx = g.idx JOIN usable y ON y.doc_id = g.doc_id AND y.idx = g.other AND y.token = x.token WHERE g.distance <= {radius} GROUP BY ALL),
walk(doc_id, idx, para_index, boost, found, known) AS (
  SELECT f.doc_id, f.idx, f.para_index, 1, o.found, list_distinct(f.tokens) FROM fragments f JOIN first_found o USING (doc_id, idx)
  UNION ALL
  (WITH lead_rows AS (SELECT w.doc_id, w.idx, w.boost, w.known, g.other, row_number() OVER (PARTITION BY w.doc_id, w.idx ORDER BY g.weighted DESC, g.distance, g.other) AS r
      FROM (SELECT doc_id, idx, boost, known, unnest(found) AS other FROM walk) w JOIN good g USING (doc_id, idx, other) QUALIFY r <= 4 * w.boost),
    fresh AS (SELECT l.doc_id, l.idx, l.boost, t.token, min(l.r) AS r FROM lead_rows l JOIN token_rows t ON t.doc_id = l.doc_id AND t.idx = l.other WHERE NOT list_contains(l.known, t.token) GROUP BY ALL),
    counted AS (SELECT doc_id, idx, boost, r, list(token) AS tokens, count(*) AS c FROM fresh GROUP BY doc_id, idx, boost, r),
    steps AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY doc_id, idx ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counted),
    bridge AS (SELECT doc_id, idx, boost, unnest(tokens) AS token FROM steps WHERE before < 4 * boost),
    reached AS (SELECT DISTINCT w.doc_id, w.idx, u.idx AS other FROM walk w JOIN bridge b ON b.doc_id = w.doc_id AND b.idx = w.idx JOIN usable u ON u.doc_id = b.doc_id AND u.token = b.token
      WHERE u.idx <> w.idx AND abs(u.para_index - w.para_index) <= {radius} * least(w.boost, {growth}) AND NOT list_contains(w.found, u.idx)),
    added AS (SELECT r.doc_id, r.idx, list(g.other) FILTER (g.other IS NOT NULL) AS others FROM reached r LEFT JOIN good g ON g.doc_id = r.doc_id AND g.idx = r.idx AND g.other = r.other GROUP BY ALL)
   SELECT w.doc_id, w.idx, w.para_index, w.boost * 2, list_concat(w.found, coalesce(a.others, [])), list_concat(w.known, b.tokens)
   FROM walk w JOIN added a USING (doc_id, idx) JOIN (SELECT doc_id, idx, list(token) AS tokens FROM bridge GROUP BY ALL) b USING (doc_id, idx))),
ended AS (SELECT doc_id, idx, unnest(max_by(found, boost)) AS other FROM walk GROUP BY doc_id, idx),
matches AS (SELECT g.* FROM good g JOIN ended e USING (doc_id, idx, other))"""


def hot(matches):
    return f"""{matches},
summed AS (SELECT m.doc_id, m.idx, count(*) AS match_count, round(sum(weighted), 9) AS density, list_distinct(flatten(list(other_tokens))) AS seen, min(other) AS first,
  min(CASE WHEN f.starts_capitalized THEN other END) AS first_capital FROM matches m JOIN fragments f ON f.doc_id = m.doc_id AND f.idx = m.other GROUP BY m.doc_id, m.idx),
reused AS (SELECT f.*, s.* EXCLUDE (doc_id, idx), len(list_intersect(list_distinct(f.tokens), seen)) AS reusable, len(list_distinct(f.tokens)) AS own FROM fragments f JOIN summed s ON s.doc_id = f.doc_id AND s.idx = f.idx),
hot AS (SELECT *, own - reusable AS "unique", reusable / greatest(1, own)::DOUBLE AS reusable_ratio,
  round(density * (1 + least(match_count, 8) / 4.0e0) * (0.5e0 + reusable / greatest(1, own)::DOUBLE), 9) AS badness,
  CASE WHEN idx < first THEN 'earliest' WHEN starts_capitalized AND (first_capital IS NULL OR idx < first_capital) THEN 'earliest-capitalized' ELSE 'redundant-candidate' END AS hint FROM reused)"""


HOT = hot(matched())

_PROFILES = {"low": (2.8, 0.5, 2, 0.65, 2, 0.08, False), "med": (1.8, 0.2, 1, 0.5, 4, 0.18, True), "high": (1.0, 0.1, 1, 0.4, 6, 0.35, True)}


def selection(profile):
    bad, viable, matches, reuse, unique, ratio, caps = _PROFILES[profile]
    return f"""{HOT},
numbered AS (SELECT h.*, greatest(1, floor(c.n * {ratio}e0)::INT) AS most, row_number() OVER (PARTITION BY h.doc_id ORDER BY badness DESC, match_count DESC, idx DESC) AS rank
  FROM hot h JOIN (SELECT doc_id, count(*) AS n FROM fragments GROUP BY doc_id) c ON c.doc_id = h.doc_id),
cutoffs AS (SELECT *, coalesce(max(CASE WHEN rank = most THEN badness END) OVER (PARTITION BY doc_id), 0) AS cutoff FROM numbered),
fit AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS pick FROM cutoffs WHERE hint = 'redundant-candidate' AND (badness >= {bad}e0 OR (badness >= cutoff AND badness >= {viable}e0))
  AND match_count >= {matches} AND reusable_ratio >= {reuse}e0 AND "unique" <= {unique}{"" if caps else " AND NOT starts_capitalized"}),
selected AS (SELECT * FROM fit WHERE pick <= most)"""


def _back(at, chars):
    return f"length(rtrim(left(text, {at}), {chars}))"


def _ahead(at, chars):
    return f"(length(text) - length(ltrim(substring(text, {at} + 1), {chars})))"


_BL, _QU, _DQ, _SE = "' ' || chr(9)", "'\"''“”‘’'", "'\"“”'", f"'{SEP}'"

LOCAL = f"""{selection("med")},
taken AS (SELECT doc_id, idx, 'local' AS method, badness AS score, source_start, source_end FROM selected)"""

_SPANS = rf"""s0 AS (SELECT s.doc_id, s.idx, s.method, s.score, s.source_start, s.source_end, d.text FROM taken s JOIN docs d ON d.doc_id = s.doc_id),
s1 AS (SELECT *, {_back("source_start", _BL)} AS l, {_ahead("source_end", _BL)} AS r FROM s0),
s2 AS (SELECT *, CASE WHEN l > 0 THEN substring(text, l, 1) ELSE '' END AS cl, substring(text, r + 1, 1) AS cr FROM s1),
s3 AS (SELECT *, cl <> '' AND instr({_SE}, cl) > 0 AND NOT (cl = ':' AND regexp_matches({strip(r"regexp_extract(left(text, l - 1), '[^\n]*\z')")}, '\A{LABEL}\z')) AS hl, cr <> '' AND instr({_SE}, cr) > 0 AS hr FROM s2),
s4 AS (SELECT * EXCLUDE (l, r), l - hl::INT AS l, r + (hr AND NOT hl)::INT AS r FROM s3),
s5 AS (SELECT * EXCLUDE (l, r), {_back("l", _BL)} AS l, {_ahead("r", _BL)} AS r FROM s4),
s6 AS (SELECT * EXCLUDE (l, r), {_back("l", _QU)} AS l, {_ahead("r", _QU)} AS r FROM s5),
s7 AS (SELECT *, substring(text, l + 1, r - l) AS gone FROM s6),
s8 AS (SELECT *, length(gone) - length(translate(gone, {_DQ}, '')) = 1 AS lone, length(gone) > 0 AND instr({_DQ}, left(gone, 1)) > 0 AND l < source_start AS ql, length(gone) > 0 AND instr({_DQ}, right(gone, 1)) > 0 AND r > source_end AS qr FROM s7),
s9 AS (SELECT *, l + (lone AND ql)::INT AS l1, r - (lone AND NOT ql AND qr)::INT AS r1 FROM s8),
spans AS (SELECT doc_id, idx, method, score, CASE WHEN lone AND ql THEN least({_ahead("l1", _BL)}, source_start) ELSE l1 END AS "left", CASE WHEN lone AND NOT ql AND qr THEN greatest({_back("r1", _BL)}, source_end) ELSE r1 END AS "right" FROM s9)"""

_MERGED = """graded AS (SELECT doc_id, idx, "left", "right", method, round(0.22e0 + 0.78e0 * CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0e0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 9) AS severity FROM spans WINDOW w AS (PARTITION BY doc_id, method)),
reached AS (SELECT *, max("right") OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, row_number() OVER o AS place FROM graded WINDOW o AS (PARTITION BY doc_id ORDER BY "left", "right", method, severity DESC)),
islands AS (SELECT *, sum((reach IS NULL OR "left" > reach)::INT) OVER (PARTITION BY doc_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS island FROM reached),
merged AS (SELECT doc_id, min("left") AS "left", max("right") AS "right", arg_max(method, severity * 1e6 - place * 1e-6) AS method, max(severity) AS severity FROM islands GROUP BY doc_id, island)"""

SPANS = f"{LOCAL},\n{_SPANS}"
MERGED = f"{SPANS},\n{_MERGED}"

CLUSTER = r"@(?:[ \t,.;!?—–\"''“”‘’]*@)+"
PUNCT = r"[,.;!?—–\"''“”‘’]+"


def markers(x):
    return sub(sub(sub(sub(x, CLUSTER, "@"), rf"[ \t]*{PUNCT}[ \t]*@[ \t]*", " @ "), rf"[ \t]*@[ \t]*{PUNCT}[ \t]*", " @ "), CLUSTER, "@")


def cleanup(x):
    nl = f"' || {NL} || '"
    x = sub(x, r"[ \t]{2,}", " ")
    x = sub(x, r"\n[ \t]+", nl)
    x = sub(x, rf"\n{{3,}}(#{{1,6}}{WS}+)", nl + nl + r"\1")
    x = sub(x, rf"([^\n])\n(#{{1,6}}{WS}+)", r"\1" + nl + nl + r"\2")
    return sub(x, r"(#{1,6}[^\n]+)\n([^\n])", r"\1" + nl + nl + r"\2")


_APPLIED = f"""kept AS (SELECT doc_id, "left", substring(text, prev + 1, "left" - prev) AS piece FROM (SELECT m.doc_id, m."left", d.text, coalesce(lag(m."right") OVER (PARTITION BY m.doc_id ORDER BY m."left"), 0) AS prev FROM merged m JOIN docs d ON d.doc_id = m.doc_id)),
tails AS (SELECT doc_id, max("right") AS cut FROM merged GROUP BY doc_id),
joined AS (SELECT doc_id, string_agg(piece, ' @ ' ORDER BY "left") AS body FROM kept GROUP BY doc_id),
rough AS (SELECT d.doc_id, d.text, CASE WHEN t.cut IS NULL THEN d.text ELSE j.body || ' @ ' || substring(d.text, t.cut + 1) END AS cut_text FROM docs d LEFT JOIN tails t ON t.doc_id = d.doc_id LEFT JOIN joined j ON j.doc_id = d.doc_id),
applied AS (SELECT doc_id, text, {cleanup(markers("cut_text"))} AS rewritten FROM rough)"""

APPLIED = f"{MERGED},\n{_APPLIED}"

_METRICS = f"""metrics AS (SELECT a.doc_id, {words("a.text")} AS original_words, {words("a.rewritten")} AS kept_words, coalesce(f.n, 0) AS fragments, coalesce(h.n, 0) AS near_matched, coalesce(m.n, 0) AS removed_fragments, coalesce(m.near, 0) AS local_removed, coalesce(m.n - m.near, 0) AS scaffold_removed
  FROM applied a LEFT JOIN (SELECT doc_id, count(*) AS n FROM fragments GROUP BY 1) f ON f.doc_id = a.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM hot GROUP BY 1) h ON h.doc_id = a.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (method = 'local') AS near FROM merged GROUP BY 1) m ON m.doc_id = a.doc_id),
doc_metrics AS (SELECT *, greatest(0, original_words - kept_words) AS stripped_words, round(kept_words / greatest(1, original_words)::DOUBLE * 100, 6) AS kept_pct FROM metrics)"""

METRICS = f"{APPLIED},\n{_METRICS}"

MASKS = """
bits AS (SELECT len AS length, m AS mask, bit_count(m) AS k FROM (SELECT unnest(range(5, 10)) AS len), (SELECT unnest(range(2, 512, 2)) AS m) WHERE m < (1 << len)),
masks AS (SELECT length::INT AS length, mask::INT AS mask FROM bits WHERE k <= least(3, greatest(1, length - 4)))"""

_TEMPLATES = f"""{MASKS},
starts AS (SELECT doc_id, idx, section, tokens, unnest(range(0, len(tokens) - 4)) AS start FROM fragments WHERE len(tokens) >= 5),
windows AS (SELECT s.doc_id, s.idx, s.section, s.start, m.length, m.mask, list_slice(tokens, start + 1, start + m.length) AS win FROM starts s JOIN masks m ON s.start + m.length <= len(s.tokens)),
occ AS (SELECT *, list_transform(win, lambda t, i: CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN '_' ELSE t END) AS template FROM windows),
solid AS (SELECT * FROM occ WHERE len(list_distinct(list_filter(template, lambda t: t <> '_'))) >= 3),
frequent AS MATERIALIZED (SELECT template, count(*) AS n FROM solid GROUP BY template HAVING count(*) >= 4),
held AS MATERIALIZED (SELECT o.*, f.n FROM solid o JOIN frequent f ON o.template = f.template),
slotted AS (SELECT template, slot, token FROM (SELECT template, unnest(list_filter(range(1, len(template) + 1), lambda i: template[i] = '_')) AS slot, win FROM held) q, LATERAL (SELECT win[slot] AS token) GROUP BY ALL),
variety AS (SELECT template, count(*) AS slot_variety, count(DISTINCT slot) AS slots FROM slotted GROUP BY template),
parts_of AS (SELECT template, count(DISTINCT section) AS sections FROM held GROUP BY template),
templates AS (SELECT f.template, f.n AS count, s.sections, v.slot_variety, v.slots FROM frequent f JOIN variety v ON v.template = f.template JOIN parts_of s ON s.template = f.template),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, count DESC, slot_variety DESC, len(template) DESC, text) AS rank FROM (SELECT *, array_to_string(template, ' ') AS text,
  round(count * (1 + least(slot_variety, 24) / 8.0e0) * (1 + slots / 3.0e0) * ((len(template) - slots) / len(template)::DOUBLE) * (1 + least(sections, 4) / 8.0e0), 6) AS score FROM templates WHERE slot_variety > slots))"""

TEMPLATES = f"{FRAGMENTS},\n{_TEMPLATES}"

# the greedy choice: every step takes the best rank left and drops those that clash with it
_CHOSEN = """prints AS MATERIALIZED (SELECT DISTINCT r.rank, h.doc_id, h.idx, unnest(range(h.start, h.start + h.length)) AS place FROM held h JOIN ranked r ON r.template = h.template),
extents AS MATERIALIZED (SELECT rank, count(*) AS n FROM prints GROUP BY rank),
choice(step, rank, taken) AS (
  SELECT 0, rank, (SELECT min(rank) FROM ranked) FROM ranked
  UNION ALL
  (WITH gone AS (SELECT b.rank FROM prints a JOIN prints b USING (doc_id, idx, place) JOIN extents x ON x.rank = a.rank JOIN extents y ON y.rank = b.rank
      WHERE a.rank = (SELECT min(rank) FROM choice) GROUP BY b.rank, x.n, y.n HAVING count(*) / least(x.n, y.n)::DOUBLE >= 0.72e0),
    left_over AS (SELECT step, rank FROM choice WHERE rank <> taken AND rank NOT IN (SELECT rank FROM gone))
   SELECT step + 1, rank, (SELECT min(rank) FROM left_over) FROM left_over WHERE step < 39)),
chosen AS (SELECT r.*, row_number() OVER (ORDER BY r.count DESC, r.rank) AS model_rank FROM ranked r WHERE r.rank IN (SELECT taken FROM choice))"""

CHOSEN = f"{TEMPLATES},\n{_CHOSEN}"

_MODELS = """cells AS (SELECT r.model_rank, h.length, r.count AS source_count, h.win, unnest(range(1, h.length + 1)) AS p FROM held h JOIN chosen r ON r.template = h.template),
probs AS (SELECT *, n / source_count::DOUBLE AS prob FROM (SELECT model_rank, length, source_count, p - 1 AS pos, win[p] AS token, count(*) AS n FROM cells GROUP BY ALL))"""

MODELS = f"{CHOSEN},\n{_MODELS}"

_CANDIDATES = """words AS (SELECT doc_id, idx, para_index, len(tokens) AS n_tokens, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS spot FROM fragments),
wins AS (SELECT * EXCLUDE (total), round(total / length, 9) AS score FROM (SELECT doc_id, model_rank, idx, para_index, spot - pos AS start, length, sum(prob) AS total, count(*) AS matched, max(prob) AS peak FROM words JOIN probs USING (token) WHERE spot - pos >= 0 AND spot - pos + length <= n_tokens GROUP BY ALL)),
cands AS (SELECT * EXCLUDE (b, length) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, model_rank, idx ORDER BY score DESC, matched DESC, start) AS b FROM wins WHERE matched >= greatest(3, floor(length * 0.68e0)) AND score >= 0.52e0) WHERE b = 1)"""


CANDIDATES = f"{MODELS},\n{_CANDIDATES}"


def _picked(name):
    if name.startswith("keep-"):
        return f"picked AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, model_rank, para_index ORDER BY score DESC, idx) AS k FROM cands) WHERE k > {name[5:]})"
    return """ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, model_rank ORDER BY score, idx) AS o, count(*) OVER (PARTITION BY doc_id, model_rank) AS c FROM cands),
limits AS (SELECT *, greatest(0.58e0, max(CASE WHEN o = floor(c * 0.72e0) + 1 THEN score END) OVER (PARTITION BY doc_id, model_rank)) AS t FROM ordered),
picked AS (SELECT * EXCLUDE (k, o, c, t) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, model_rank, para_index ORDER BY score DESC, idx) AS k FROM limits WHERE score >= t) WHERE k > 1)"""


def policy(name):
    return f"{CANDIDATES},\n{_picked(name)}"


def batch(name):
    """Metrics of the pass with models of the whole corpus: local and scaffold removals together."""
    return f"""{selection("med")},
{_TEMPLATES},
{_CHOSEN},
{_MODELS},
{_CANDIDATES},
{_picked(name)},
first_models AS (SELECT doc_id, idx, arg_min(score, model_rank) AS score FROM picked GROUP BY doc_id, idx),
taken AS (SELECT doc_id, idx, 'local' AS method, badness AS score, source_start, source_end FROM selected
  UNION ALL SELECT m.doc_id, m.idx, 'scaffold', m.score, f.source_start, f.source_end FROM first_models m JOIN fragments f ON f.doc_id = m.doc_id AND f.idx = m.idx),
{_SPANS},
{_MERGED},
{_APPLIED},
{_METRICS}"""


def query(docs, ctes, select):
    return f"WITH RECURSIVE {docs}, {ctes.strip()} {select}"
