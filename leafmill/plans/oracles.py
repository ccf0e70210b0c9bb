"""DuckDB SQL for the queries, written apart from them."""

from __future__ import annotations

from leafmill.functions import text as T
from leafmill.plans import inputs as I
from leafmill.plans import literals as L

WS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def one_byte(x: str) -> str:
    """Letters that ASCII lacks as one mark: DuckDB's edit distance counts bytes, and the known words here have none."""
    return f"regexp_replace({x}, '[^ -~]', '~', 'g')"


def hits(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def like(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def garbled(x: str) -> str:
    letters, digits = hits(x, r"\p{L}"), hits(x, r"\p{Nd}")
    odd = f"({hits(x, T.GLUED_SIGN)} + {hits(x, T.GLUED_DIGIT)})"
    return f"""CASE WHEN {x} IS NULL OR {x} = '' THEN false
      WHEN {digits} >= 4 AND {letters} <= 1 THEN true
      WHEN {letters} < 2 THEN false
      WHEN {like(x, T.GLUED_HYPHEN)} THEN true
      WHEN length({x}) <= 40 AND {like(x, '[)(]')} AND {like(x, chr(92) + 'p{Nd}')} AND {like(x, '[' + T.CYRILLIC + ']')} AND {digits} <= 4 THEN true
      ELSE {odd} >= 2 OR ({odd} >= 1 AND length({x}) <= 80) END"""


def suspect(x: str) -> str:
    edge = q(T.TOKEN_EDGE)
    letter = "[A-Za-zА-Яа-яЁёЇіІїЄєҐґ]"
    tokens = f"[t FOR t IN [trim(w, {edge}) FOR w IN regexp_split_to_array({strip(x)}, '[\\s]+')] IF length(t) >= 3 AND {like('t', letter)} AND {like('t', chr(92) + 'p{Nd}')} AND {like('t', '[/;:=)(]')}]"
    return f"(({garbled(x)}) OR coalesce(len({tokens}), 0) >= 2)"


def level(size: str, x: str, body: str) -> str:
    t = strip(x)
    return f"""CASE WHEN length({t}) > 80 OR ({garbled(t)}) OR {like(f'lower({t})', T.IMPRINT_CODE)} OR {like(f'lower({t})', T.IMPRINT_MARK)} THEN 'para'
      WHEN ({like(f'lower({t})', T.HEADING_WORD)} AND length({t}) < 50 AND NOT {like(t, '[.!?]$')}) OR {size} >= {body} * 1.9::DOUBLE THEN 'h1'
      WHEN {size} >= {body} * 1.55::DOUBLE THEN 'h2' WHEN {size} >= {body} * 1.28::DOUBLE THEN 'h3' ELSE 'para' END"""


LINES = f"""
pages_ AS (SELECT doc_id, source AS book, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INTEGER AS page, text FROM documents),
raw_ AS (SELECT book, page, len(string_split(text, chr(10))) AS n, unnest(string_split(text, chr(10))) AS raw, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INTEGER AS line_no FROM pages_),
trim_ AS (SELECT book, page, line_no, n, {strip('raw')} AS text FROM raw_),
lines AS (SELECT book, page, line_no, text, (52 + CASE WHEN line_no % 3 = 2 THEN 18 ELSE 0 END)::DOUBLE AS x0,
   least(356.0::DOUBLE, (52 + CASE WHEN line_no % 3 = 2 THEN 18 ELSE 0 END + 5 * length(text))::DOUBLE) AS x1,
   (30 + 14 * line_no)::DOUBLE AS y0, (42 + 14 * line_no)::DOUBLE AS y1,
   CASE WHEN length(text) <= 24 AND line_no = 0 THEN 24 WHEN length(text) <= 30 AND line_no % 5 = 0 THEN 18 WHEN length(text) <= 30 AND line_no % 5 = 1 THEN 15 ELSE 11.5 END::DOUBLE AS size,
   greatest(595, 60 + 14 * n)::DOUBLE AS page_h FROM trim_ WHERE length(text) > 0)"""
IDS = LINES + """,
ids AS (SELECT *, row_number() OVER (ORDER BY book, page, line_no) - 1 AS id FROM lines)"""
BOXES = IDS + """,
boxes AS (SELECT book, page, line_no, text, id, line_no % 7 = 3 AS image, x0 - CASE WHEN line_no % 7 = 3 THEN 40 ELSE 0 END AS x0,
   x1 + CASE WHEN line_no % 7 = 3 THEN 40 ELSE 0 END AS x1, y0, y1, size, page_h FROM ids)"""
BODY_ = """
body AS (SELECT book, coalesce((array_agg(half ORDER BY n DESC, first) FILTER (n > 0))[1], 11.0)::DOUBLE AS body FROM (
   SELECT book, round_even(size * 2, 0) / 2 AS half, count(*) FILTER (length(text) >= 25) AS n, min((page, line_no)) FILTER (length(text) >= 25) AS first
   FROM lines GROUP BY ALL) GROUP BY book)"""
BODY = LINES + "," + BODY_
ZONE = "(y0 < page_h * 0.12::DOUBLE OR y1 > page_h * 0.88::DOUBLE)"
HEADERS = f"""
zone_ AS (SELECT DISTINCT book, page, lower({strip("regexp_replace(text, '" + chr(92) + "p{Nd}+', '', 'g')")}) AS header FROM lines WHERE {ZONE}),
counted_ AS (SELECT book, header, count(*) AS pages FROM zone_ WHERE length(header) BETWEEN 3 AND 60 GROUP BY ALL),
headers AS (SELECT c.book, header, pages FROM counted_ c JOIN (SELECT book, count(DISTINCT page) AS n FROM lines GROUP BY book) b ON b.book = c.book WHERE pages >= greatest(3, floor(0.02::DOUBLE * n)))"""
TOC = f"""
top_ AS (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY line_no) AS rn FROM toc_lines),
toc AS (SELECT book, page, ({' OR '.join(f"starts_with(head, {q(t)})" for t in T.TOC_TITLES)}) OR (n >= 4 AND leaders >= greatest(3, n // 2)) AS is_toc FROM (
   SELECT book, page, lower(regexp_replace(coalesce(string_agg(text, ' ' ORDER BY line_no) FILTER (rn <= 2), ''), '\\s+', '', 'g')) AS head, count(*) AS n, count(*) FILTER ({like('text', T.LEADERS)}) AS leaders
   FROM top_ GROUP BY ALL))"""
KEPT = HEADERS + f""",
kept AS (SELECT lines.* FROM lines JOIN body USING (book) WHERE NOT ({ZONE} AND {like('text', T.PAGE_NUMBER)}) AND NOT {like('text', T.LEADERS)}
  AND NOT ({ZONE} AND size < body * 1.25::DOUBLE AND EXISTS (SELECT 1 FROM headers h WHERE h.book = lines.book AND h.header = lower({strip("regexp_replace(text, '" + chr(92) + "p{Nd}+', '', 'g')")}))))"""
GAPS = """
gap_ AS (SELECT book, page, y0 - lag(y1) OVER (PARTITION BY book, page ORDER BY line_no) AS gap FROM {lines}),
gaps AS (SELECT book, page, coalesce(list_sort(list(gap) FILTER (gap > 0))[count(*) FILTER (gap > 0) // 2 + 1], 4.0)::DOUBLE AS median_gap FROM gap_ GROUP BY ALL)"""
STARTS = f"""
kinds AS (SELECT l.*, b.body, g.median_gap, {level('l.size', 'l.text', 'b.body')} AS kind FROM kept l JOIN body b USING (book) JOIN gaps g USING (book, page) ANTI JOIN skip_ k ON k.book = l.book AND k.page = l.page),
prev_ AS (SELECT *, lag(kind) OVER w AS pk, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, min(x0) OVER (PARTITION BY book, page) AS lft,
   greatest(max(x1) OVER (PARTITION BY book, page) - min(x0) OVER (PARTITION BY book, page), 1) AS wid FROM kinds WINDOW w AS (PARTITION BY book, page ORDER BY line_no)),
starts AS (SELECT *, CASE WHEN pk IS NULL OR pk <> kind THEN true WHEN kind <> 'para' THEN y0 - py1 > median_gap * 2.5::DOUBLE + 1
   ELSE (x0 - lft > wid * 0.03::DOUBLE AND x0 - px0 > 4) OR y0 - py1 > median_gap * 1.8::DOUBLE + 0.5::DOUBLE OR (px1 - lft < wid * 0.6::DOUBLE AND {like('text', T.CAPITAL_START)}) END AS s FROM prev_),
nos AS (SELECT *, sum(s::INTEGER) OVER (PARTITION BY book, page ORDER BY line_no) - 1 AS par_no FROM starts)"""


def joined(source: str, group: str, order: str) -> str:
    """Texts of a group in order; a hyphen before a lower-case start goes. Done by marks that no text holds."""
    glue = f"CASE WHEN {like('nxt', T.LOWER_START)} AND {like('text', T.HYPHEN_END)} THEN left(text, length(text) - 1) WHEN nxt IS NULL THEN text ELSE text || ' ' END"
    return f"SELECT {group}, first(kind ORDER BY {order}) AS kind, string_agg({glue}, '' ORDER BY {order}) AS text, min(y0) AS y0 FROM (SELECT *, lead(text) OVER (PARTITION BY {group} ORDER BY {order}) AS nxt FROM {source}) GROUP BY {group}"


SKIP = ("""
toc_lines AS (SELECT book, page, line_no, text FROM kept),""" + TOC + """,
skip_ AS (SELECT book, page FROM toc WHERE is_toc UNION SELECT book, min(page) FROM kept WHERE page > 0 GROUP BY book UNION SELECT book, 0 FROM kept)""")
FLOW_ = BODY_ + "," + KEPT + "," + GAPS.replace("{lines}", "kept ANTI JOIN skip_ USING (book, page)") + "," + STARTS + f""",
pars AS ({joined('nos', 'book, page, par_no', 'line_no')})"""
FLOW_ = FLOW_.replace("gap_ AS", SKIP.strip() + ",\ngap_ AS")
PARS = LINES + "," + FLOW_
SET_LINES = r"""
set_ AS (SELECT source AS book, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS doc, [x FOR x IN string_split_regex(text, '[ \t\n\x0b\x0c\r]+') IF x <> ''] AS w FROM documents),
cut_ AS (SELECT book, doc, unnest([array_to_string(w[k * 10 + 1:k * 10 + 10], ' ') FOR k IN range(0, (len(w) + 9) // 10)]) AS text, unnest(range(0, (len(w) + 9) // 10)) AS k FROM set_ WHERE len(w) > 0),
lines AS (SELECT book, doc * 10000000 + k // 30 AS page, (k % 30)::INTEGER AS line_no, text, 52::DOUBLE AS x0, least(356, 52 + 5 * length(text))::DOUBLE AS x1, (30 + 14 * (k % 30))::DOUBLE AS y0, (42 + 14 * (k % 30))::DOUBLE AS y1, 11.5::DOUBLE AS size, 480::DOUBLE AS page_h FROM cut_)"""
CROSS = SET_LINES + "," + FLOW_ + f""",
on_ AS (SELECT *, coalesce(kind = 'para' AND lag(kind) OVER w = 'para' AND NOT {like("lag(text) OVER w", T.SENTENCE_END)} AND {like('text', T.LOWER_START)}, false) AS c FROM (SELECT book, page, par_no, kind, text, y0 FROM pars UNION ALL SELECT * FROM {L.values(L.FLOW)}) WINDOW w AS (PARTITION BY book ORDER BY page, par_no)),
run_ AS (SELECT *, sum(1 - c::INTEGER) OVER (PARTITION BY book ORDER BY page, par_no) AS run FROM on_),
join_ AS (SELECT *, c AND page <> first_value(page) OVER (PARTITION BY book, run ORDER BY page, par_no) AS j FROM run_),
flow_ AS (SELECT *, sum(1 - j::INTEGER) OVER (PARTITION BY book ORDER BY page, par_no) - 1 AS flow_no FROM join_),
flow AS ({joined('flow_', 'book, flow_no', 'page, par_no')})"""


HEAD_PAGES = f"""
      h AS (SELECT book, page AS own, par_no, lower(left(regexp_replace({strip('text')}, '\\s+', ' ', 'g'), 40)) AS needle, row_number() OVER (PARTITION BY book ORDER BY page, par_no) AS rn FROM pars WHERE kind <> 'para'),
      b AS (SELECT book, page, lower(regexp_replace(string_agg(text, ' ' ORDER BY line_no), '\\s+', ' ', 'g')) AS body FROM lines GROUP BY ALL),
      m AS (SELECT h.book, h.rn, b.page FROM h JOIN b ON b.book = h.book AND needle <> '' AND contains(b.body, needle)),
      heads_ AS (SELECT book, own, par_no, rn, coalesce((SELECT min(page) FROM m WHERE m.book = h.book AND m.rn = h.rn), 0) AS page FROM h WHERE rn = 1
        UNION ALL SELECT h.book, h.own, h.par_no, h.rn, coalesce((SELECT min(m.page) FROM m WHERE m.book = h.book AND m.rn = h.rn AND m.page >= s.page), s.page) FROM heads_ s JOIN h ON h.book = s.book AND h.rn = s.rn + 1)"""


def key(x: str) -> str:
    return f"lower(regexp_replace(coalesce({x}, ''), '[\\s\\-­]+', '', 'g'))"


def lum(r: str, g: str, b: str) -> str:
    return f"(0.299::DOUBLE * {r} + 0.587::DOUBLE * {g} + 0.114::DOUBLE * {b})"


def hexed(x: str, i: int) -> str:
    bare = f"regexp_replace(coalesce({strip(x)}, ''), '^#+', '')"
    full = f"CASE WHEN length({bare}) = 3 THEN regexp_replace({bare}, '(.)', '\\1\\1', 'g') ELSE {bare} END"
    return f"CASE WHEN regexp_matches({full}, '^[0-9a-fA-F]{{6}}$') THEN ('0x' || substr({full}, {i}, 2))::INTEGER END"


def titles(pages: str, n_titles: int, n_authors: int) -> str:
    return f"""
tl_ AS (SELECT l.*, l.size >= 0.7::DOUBLE * max(l.size) OVER (PARTITION BY l.book) AS large FROM lines l JOIN {pages} p USING (book, page)),
kd_ AS (SELECT *, CASE WHEN large AND length(text) >= 2 THEN 't' WHEN NOT large AND length(text) BETWEEN 3 AND 60 THEN 'a' END AS k FROM tl_),
pl_ AS (SELECT *, row_number() OVER (PARTITION BY book, k ORDER BY line_no) AS place FROM kd_ WHERE k IS NOT NULL)
SELECT book, left(coalesce(string_agg(text, ' ' ORDER BY place) FILTER (k = 't' AND place <= {n_titles}), ''), 120) AS title,
  coalesce(string_agg(text, '; ' ORDER BY place) FILTER (k = 'a' AND place <= {n_authors}), '') AS authors FROM pl_ GROUP BY book"""


TITLE_PAGES = """
tp_ AS (SELECT book, min(page) AS page FROM (SELECT book, page FROM lines WHERE page > 0 GROUP BY ALL HAVING sum(length(text)) >= 15) JOIN (SELECT book, page FROM toc WHERE NOT is_toc) USING (book, page) GROUP BY book)"""
BUDGET = "CASE WHEN n IS NULL THEN 3600 ELSE greatest(1800, least(14400, (1800 + floor(1200 * n / 100.0)) * {k})) END::BIGINT"
TARGET02 = "CASE WHEN line_no % 4 = 1 THEN ' ' WHEN line_no % 9 = 2 THEN 'broken,-text' ELSE upper(text) END"
V = L.values

ORACLES: dict[str, str] = {
    "p02_global_ids": f"WITH {IDS} SELECT book, page, line_no, id FROM ids",
    "p05_translatable": f"SELECT id, regexp_matches(text, '\\p{{L}}') AS is_real FROM (SELECT id::BIGINT AS id, coalesce(text, '') AS text FROM {V(L.TEXTS)} UNION ALL SELECT doc_id + 1000, text FROM documents)",
    "p11_garble_lines": f"WITH {LINES} SELECT book, page, line_no FROM lines WHERE length(text) >= 4 AND ({garbled('text')})",
    "p11_garble_calibration": f"SELECT id, {garbled('text')} AS verdict FROM {V(L.TEXTS)}",
    "p12_suspect_lines": f"WITH {LINES} SELECT * FROM (SELECT book, page, line_no, {suspect('text')} AS verdict FROM (SELECT 'literal' AS book, 0 AS page, id AS line_no, text FROM {V(L.TEXTS)} UNION ALL SELECT book, page, line_no, text FROM lines)) WHERE verdict",
    "p13_scanned_books": f"WITH {LINES} SELECT book, count(DISTINCT page) AS pages, sum(length(text))::BIGINT AS chars, count(DISTINCT page) >= 3 AND sum(length(text)) < 2400 * count(DISTINCT page) AS scanned FROM lines GROUP BY book",
    "p15_toc_pages": f"WITH {LINES}, toc_lines AS (SELECT book, page, line_no, text FROM lines UNION ALL SELECT * FROM {V(L.TOC)}), {TOC} SELECT * FROM toc",
    "p16_artifacts_removed": f"""WITH {BODY}, {HEADERS} SELECT book, page, line_no FROM lines JOIN body USING (book) WHERE NOT ({ZONE} AND {like('text', T.PAGE_NUMBER)}) AND NOT {like('text', T.LEADERS)}
      AND NOT ({ZONE} AND size < body * 1.25::DOUBLE AND EXISTS (SELECT 1 FROM headers h WHERE h.book = lines.book AND h.header = lower({strip("regexp_replace(text, '" + chr(92) + "p{Nd}+', '', 'g')")})))""",
    "p19_heading_levels": f"WITH {BODY} SELECT book, {level('size', 'text', 'body')} AS kind, count(*) AS n FROM lines JOIN body USING (book) GROUP BY ALL UNION ALL SELECT 'literal ' || id, {level('size', 'text', '11.5::DOUBLE')}, 1 FROM {V(L.HEADINGS)}",
    "p20_placement": f"""WITH {LINES}, c AS (SELECT book, page, greatest(1, round_even(size, 0)::INTEGER) AS w, count(*) AS n, min(line_no) AS f FROM lines GROUP BY ALL),
      b AS (SELECT book, page, least(16, greatest(6, (array_agg(w ORDER BY n DESC, f))[1])) AS body FROM c GROUP BY ALL)
      SELECT book, page, line_no, size >= body * 1.4::DOUBLE AND length(text) <= 55 AS is_head, CASE WHEN size >= body * 1.4::DOUBLE AND length(text) <= 55 THEN least(size, body * 2.2::DOUBLE) ELSE body::DOUBLE END AS place_size FROM lines JOIN b USING (book, page)""",
    "p21_skip_pages": f"WITH {LINES}, toc_lines AS (SELECT book, page, line_no, text FROM lines), {TOC} SELECT DISTINCT book, 0 AS page, 'cover' AS reason FROM lines UNION ALL SELECT book, min(page), 'title' FROM lines WHERE page > 0 GROUP BY book UNION ALL SELECT book, page, 'contents' FROM toc WHERE is_toc",
    "p23_status_projection": f"SELECT job_id, status, progress, name, left(regexp_replace(error, 'key=[A-Za-z0-9_.-]+', 'key=***', 'g'), 200) AS error FROM {I.sql(I.JOBS)}",
    "p25_bit_unpack": f"""SELECT id, colour >> 16 & 255 AS red, colour >> 8 & 255 AS green, colour & 255 AS blue, flags & 16 <> 0 OR size >= 15 AS bold, flags & 2 <> 0 AS italic, flags & 4 <> 0 AS serif,
      round({lum('(colour >> 16 & 255)', '(colour >> 8 & 255)', '(colour & 255)')}, 6) AS luminance, {hexed('hex', 1)} AS hex_red, {hexed('hex', 5)} AS hex_blue FROM {I.sql(I.COLOURS)}""",
    "p08_need_set": f"""WITH {PARS} SELECT book, page, par_no::BIGINT AS par_no, CASE WHEN NOT regexp_matches(text, '\\p{{L}}') THEN 'unchanged' WHEN {garbled('text')} THEN 'dropped'
      WHEN {key('text')} IN (SELECT {key('text')} FROM pars WHERE page % 3 = 0) THEN 'cached' ELSE 'needed' END AS state FROM pars""",
    "p10_length_ranges": f"SELECT ord, term, length(term) BETWEEN 2 AND 60 AND length(value) BETWEEN 1 AND 80 AS kept FROM {I.sql(I.GLOSSARY)}",
    "p24_job_list": f"SELECT job_id, status, progress, name, count(*) FILTER (status IN ('queued', 'processing')) OVER () AS active, coalesce(nullif(trim(fixed_key), ''), nullif(trim(slot_key), ''), 'none') AS resolved FROM {I.sql(I.JOBS)}",
    "j01_translation_lookup": f"WITH {IDS} SELECT id::BIGINT AS id, CASE WHEN id % 3 = 0 THEN {strip('lower(text)')} ELSE text END AS target FROM ids",
    "j03_zip_results": f"WITH {LINES} SELECT book, page, line_no, length(text)::INTEGER AS value FROM lines",
    "j04_checkpoint_anti": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "j05_cache_reuse": f"SELECT doc_id, reused_from FROM (SELECT doc_id, {key('text')} AS k, max(doc_id) OVER (PARTITION BY {key('text')}) AS reused_from FROM documents) WHERE reused_from <> doc_id AND k <> ''",
    "j06_glossary_merge": f"WITH g AS (SELECT term, (array_agg(value ORDER BY ord))[1] AS value FROM {I.sql(I.GLOSSARY)} WHERE length(value) > 0 GROUP BY term) SELECT coalesce(g.term, p.term) AS term, coalesce(g.value, p.term) AS value FROM g FULL JOIN {V(L.PINS)} p ON g.term = p.term",
    "j07_active_job_semi": f"SELECT s.file_hash, s.layout, s.submit, (SELECT min(job_id) FROM {I.sql(I.JOBS)} j WHERE j.file_hash = s.file_hash AND j.layout = s.layout AND j.status IN ('queued', 'processing')) AS reused FROM {I.sql(I.SUBMITS)} s",
    "t07_duplicate_texts": "SELECT doc_id, first_doc FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_doc FROM documents) WHERE doc_id <> first_doc",
    "j08_box_over_box": f"""WITH {BOXES} SELECT b.book, b.page, b.id, i.id AS image_id FROM boxes b JOIN (SELECT * REPLACE (y1 + 20 AS y1) FROM boxes WHERE image) i ON b.book = i.book AND b.page = i.page WHERE NOT b.image
      AND least(b.x1, i.x1) - greatest(b.x0, i.x0) > 0 AND least(b.y1, i.y1) - greatest(b.y0, i.y0) > 0
      AND (least(b.x1, i.x1) - greatest(b.x0, i.x0)) * (least(b.y1, i.y1) - greatest(b.y0, i.y0)) > 0.6::DOUBLE * greatest((b.x1 - b.x0) * (b.y1 - b.y0), 1)""",
    "j09_next_block_floor": f"WITH {BOXES} SELECT a.book, a.page, a.id, least(any_value(a.page_h) - 2, coalesce(min(b.y0) - 2, any_value(a.page_h))) AS floor FROM boxes a LEFT JOIN boxes b ON a.book = b.book AND a.page = b.page AND b.id <> a.id AND b.y0 > a.y0 + 2 AND b.x1 > a.x0 AND b.x0 < a.x1 GROUP BY a.book, a.page, a.id",
    "j10_box_overlaps": f"""WITH {BOXES}, t AS (SELECT * REPLACE (y1 + CASE WHEN image THEN 9 ELSE 0 END AS y1) FROM boxes)
      SELECT * FROM (SELECT a.book, a.page, a.id AS i, b.id AS j, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS area FROM t a JOIN t b ON a.book = b.book AND a.page = b.page AND a.id < b.id
      WHERE least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)
      AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 0.1::DOUBLE * greatest(least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)), 1))""",
    "j11_fuzzy_words": """WITH s AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS k FROM part),
      words AS (SELECT word, min(p_partkey * 100 + k) AS ord FROM s GROUP BY word),
      tokens AS (SELECT DISTINCT CASE WHEN ord % 2 = 0 THEN substr(word, 1, 2) || 'q' || substr(word, 4) ELSE upper(word) END AS token FROM words),
      d AS (SELECT token, word, levenshtein(lower(token), lower(word)) AS d, row_number() OVER (PARTITION BY token ORDER BY levenshtein(lower(token), lower(word)), ord) AS rn FROM tokens, words),
      f AS (SELECT token, CASE WHEN (d = 0) OR (d = 1 AND length(token) >= 2) OR (d = 2 AND length(token) >= 4) THEN CASE WHEN d = 0 THEN token WHEN token = upper(token) THEN upper(word) ELSE word END ELSE token END AS fixed FROM d WHERE rn = 1)
      SELECT token, fixed, lower(fixed) <> lower(token) AS changed FROM f""",
    "j12_fuzzy_titles": """WITH n AS (SELECT n_name AS orig, '<' || n_name || '>' AS value, n_nationkey AS ord FROM nation),
      names AS (SELECT substr(orig, 1, 3) || 'x' || substr(orig, 4) AS name FROM n UNION SELECT lower(orig) FROM n UNION SELECT '  ' || orig || ' z' FROM n),
      t AS (SELECT name, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS norm FROM names)
      SELECT t.name, (SELECT (array_agg(value ORDER BY ord))[1] FROM n WHERE length(norm) >= 3 AND (norm = lower(orig) OR (length(norm) >= 6 AND levenshtein(norm, lower(orig)) <= 2))) AS override FROM t""",
    "j13_image_placement": f"WITH {PARS}, i AS (SELECT book, page, id AS image_id, (y0 + y1) / 2 AS y FROM (WITH {BOXES} SELECT * FROM boxes) WHERE image) SELECT i.book, i.page, i.image_id, max(p.par_no)::BIGINT AS anchor FROM i LEFT JOIN pars p ON p.book = i.book AND p.page = i.page AND p.y0 <= i.y GROUP BY ALL",
    "j17_adjacent_gap": f"WITH {LINES}, {GAPS.replace(chr(123) + 'lines' + chr(125), 'lines')} SELECT * FROM gaps",
    "a03_words_to_lines": f"""WITH {LINES}, w AS (SELECT book, page, line_no, x0, y0, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS k FROM lines)
      SELECT book, page, 0 AS block_num, 0 AS par_num, line_no AS line_num, string_agg(word, ' ' ORDER BY k) AS text, min(x0 + 10 * k) / 2 AS x0, min(y0 - k % 2) / 2 AS y0, max(x0 + 10 * k + 9) / 2 AS x1, max(y0 - k % 2 + 12) / 2 AS y1
      FROM w WHERE word <> '' AND k % 7 <> 6 AND k % 5 <> 4 GROUP BY ALL""",
    "a05_body_size": f"WITH {BODY} SELECT * FROM body",
    "a06_repeated_headers": f"WITH {LINES}, {HEADERS} SELECT * FROM headers",
    "a07_argmax_span": f"SELECT block, (array_agg(text ORDER BY size DESC, ord))[1] AS winner, max(size) AS size FROM {I.sql(I.SPANS)} WHERE kind = 0 AND trim(text) <> '' GROUP BY block",
    "a09_colour_mode": f"""WITH c AS (SELECT id, r // 12 * 12 AS r, g // 12 * 12 AS g, b // 12 * 12 AS b, sum(n) AS n FROM {I.sql(I.PIXELS)} GROUP BY ALL),
      s AS (SELECT *, round(n / (sum(n) OVER (PARTITION BY id))::DOUBLE, 6) AS share, row_number() OVER (PARTITION BY id ORDER BY n DESC, r, g, b) AS rn FROM c)
      SELECT id, least(255, r + 6)::INTEGER AS r, least(255, g + 6)::INTEGER AS g, least(255, b + 6)::INTEGER AS b, share FROM s WHERE rn = 1""",
    "a11_weighted_mean": f"WITH {BOXES} SELECT book, page, round(sum(size * (x1 - x0) * (y1 - y0)) / sum((x1 - x0) * (y1 - y0)), 6) AS mean_size, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes GROUP BY ALL",
    "a13_distinct_ci": "SELECT lower(word) AS low, (array_agg(word ORDER BY doc_id, k))[1] AS word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^\\p{L}]+')) AS word, generate_subscripts(regexp_split_to_array(text, '[^\\p{L}]+'), 1) AS k FROM documents) WHERE length(word) BETWEEN 2 AND 70 GROUP BY lower(word)",
    "a15_abbreviations": f"""SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_]+')) AS token FROM (SELECT text FROM documents UNION ALL SELECT text FROM {V(L.TEXTS)}))
      WHERE regexp_matches(token, '^[А-ЯЁЇІЄҐA-Z]{{2,5}}$') AND (regexp_matches(token, '^[A-Z]{{2,5}}$') OR NOT regexp_matches(token, '[АЕЁИОУЫЭЮЯЇІЄ]')) GROUP BY token""",
    "a16_quality_report": f"""WITH {LINES}, p AS (SELECT book, page, count(*) AS n, count(*) FILTER ({suspect('text')}) AS bad FROM lines WHERE length(text) >= 4 GROUP BY ALL),
      b AS (SELECT book, sum(n)::BIGINT AS total, sum(bad)::BIGINT AS suspect, round_even(100.0::DOUBLE * sum(bad) / sum(n), 1) AS garbled_percent, string_agg((page + 1)::VARCHAR, ',' ORDER BY page) FILTER (bad >= 1) AS marked FROM p GROUP BY book)
      SELECT book, total, suspect, garbled_percent, garbled_percent >= 0.2::DOUBLE AS has_issues, CASE WHEN garbled_percent >= 0.2::DOUBLE THEN coalesce(marked, '') ELSE '' END AS suspect_pages FROM b""",
    "a22_title_guess": f"WITH {LINES}, toc_lines AS (SELECT book, page, line_no, text FROM lines), {TOC}, {TITLE_PAGES}, {titles('tp_', 4, 3)}",
    "a24_cover_title_author": f"WITH {LINES}, {titles('(SELECT DISTINCT book, page FROM lines WHERE page = 0)', 1, 1)}",
    "w02_paragraphs": f"WITH {PARS} SELECT book, page, par_no::BIGINT AS par_no, kind, md5(text) AS text_md5, y0 FROM pars",
    "w03_cross_page": f"WITH {CROSS} SELECT book, flow_no::BIGINT AS flow_no, kind, md5(text) AS text_md5 FROM flow",
    "w04_runs": f"""WITH m AS (SELECT block, y, y - lag(y) OVER (PARTITION BY block ORDER BY y) - 1 AS gap FROM {I.sql(I.MASK)} WHERE v),
      r AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY block ORDER BY y) AS run FROM m)
      SELECT block, min(y) AS run_start, max(y) + 1 AS run_end FROM r GROUP BY block, run HAVING max(y) + 1 - min(y) >= 3""",
    "w05_batches": """WITH RECURSIVE o AS (SELECT source, doc_id, coalesce(n_chars, 0) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
      f AS (SELECT source, doc_id, rn, 0::BIGINT AS batch, n + 9 AS used FROM o WHERE rn = 1 UNION ALL
        SELECT o.source, o.doc_id, o.rn, f.batch + (f.used + o.n > 2500)::BIGINT, CASE WHEN f.used + o.n > 2500 THEN 0 ELSE f.used END + o.n + 9 FROM f JOIN o ON o.source = f.source AND o.rn = f.rn + 1)
      SELECT source, doc_id, batch FROM f""",
    "w06_systematic_sample": f"""WITH {LINES}, s AS (SELECT book, text, row_number() OVER (PARTITION BY book ORDER BY page, line_no) - 1 AS number, count(*) OVER (PARTITION BY book) AS n FROM lines),
      d AS (SELECT *, sum(length(text)) OVER (PARTITION BY book ORDER BY number) - length(text) AS filled FROM s WHERE number % greatest(1, n // 120) = 0 AND length(text) >= 12) SELECT book, number FROM d WHERE filled < 3000""",
    "w07_greedy_wrap": """WITH RECURSIVE t AS (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_brand || ' ' || p_type, ' ')) AS w, generate_subscripts(string_split(p_name || ' ' || p_brand || ' ' || p_type, ' '), 1) AS k FROM part),
      f AS (SELECT p_partkey, k, 0 AS line_no, w AS line, w FROM t WHERE k = 1 UNION ALL
        SELECT t.p_partkey, t.k, f.line_no + (length(f.line) + 1 + length(t.w) > 16)::INTEGER, CASE WHEN length(f.line) + 1 + length(t.w) > 16 THEN t.w ELSE f.line || ' ' || t.w END, t.w FROM f JOIN t ON t.p_partkey = f.p_partkey AND t.k = f.k + 1)
      SELECT p_partkey, line_no, (array_agg(line ORDER BY k DESC))[1] AS text FROM f GROUP BY p_partkey, line_no""",
    "w08_segments": f"""WITH {PARS}, s AS (SELECT *, sum(CASE WHEN kind = 'h1' AND rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY page, par_no) AS segment FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page, par_no) AS rn FROM pars))
      SELECT book, page, par_no::BIGINT AS par_no, segment::BIGINT AS segment, kind = 'para' AND coalesce(lag(kind) OVER (PARTITION BY book, segment ORDER BY page, par_no) <> 'para', false) AS unindented FROM s""",
    "w12_page_chunks": f"WITH {LINES} SELECT book, (page // 40)::BIGINT AS chunk, min(page) AS first_page, max(page) AS last_page, count(*) AS lines FROM lines GROUP BY book, page // 40",
    "f06_token_split": f"""WITH {LINES}, t AS (SELECT book, page, line_no, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')) AS token, (generate_subscripts(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), 1) - 1)::INTEGER AS k FROM lines)
      SELECT book, page, line_no, k, trim(token, {q(T.TOKEN_EDGE)}) AS core, regexp_matches(token, '^[\\p{{L}}\\p{{N}}_]') AS is_word FROM t""",
    "f11_html_escape": "WITH e AS (SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS x FROM pages) SELECT page_id, md5(x) AS escaped_md5, length(x) AS n FROM e",
    "f12_json_extract": "SELECT event_id, coalesce(nullif(regexp_extract('Sure:' || chr(10) || props || chr(10) || 'bye', '(?s)\\{.*\\}'), ''), '{}') AS object FROM events",
    "f13_cover_json": f"""WITH c AS (SELECT p_partkey + 100 AS id, p_name, p_size, p_size::DOUBLE AS x, (p_size % 17)::DOUBLE AS y, (p_size * 3 % 130)::DOUBLE AS w, (p_size % 13)::DOUBLE AS h, {I.SIX_DIGITS} AS c FROM part),
      n AS (SELECT * REPLACE (CASE WHEN big THEN x / 8 ELSE x END AS x, CASE WHEN big THEN y / 6 ELSE y END AS y, CASE WHEN big THEN w / 8 ELSE w END AS w, CASE WHEN big THEN h / 6 ELSE h END AS h) FROM (SELECT *, greatest(x, y, w, h) > 100 AS big FROM c))
      SELECT * FROM (VALUES (1, 0, 'Title', 10.0::DOUBLE, 5.0::DOUBLE, 90.0::DOUBLE, 20.0::DOUBLE, 'title', 255), (2, 0, 'Pixels', 50.0, 50.0, 25.0, 25.0, 'other', 0), (5, 0, 'Author Name', 50.0, 90.0, 50.0, 10.0, 'author', 16)) v(id, k, text, x, y, w, h, role, red)
      UNION ALL SELECT id, 0, p_name, x, y, least(w, 100 - x), least(h, 100 - y), CASE WHEN p_size % 2 = 0 THEN 'title' ELSE 'other' END, ('0x' || c[1:2])::INTEGER FROM n WHERE x < 100 AND y < 100 AND w > 0 AND h > 0""",
    "f16_contrast_colour": f"""WITH p AS (SELECT *, CASE WHEN {lum('r', 'g', 'b')} < 128 THEN 255 ELSE 0 END AS goal FROM {I.sql(I.PIXELS)}),
      s AS (SELECT id, r, g, b, k, {lum('floor(r + (goal - r) * (k * 0.2::DOUBLE))', 'floor(g + (goal - g) * (k * 0.2::DOUBLE))', 'floor(b + (goal - b) * (k * 0.2::DOUBLE))')} AS l FROM p, range(0, 6) t(k))
      SELECT id, r, g, b, coalesce(min(k) FILTER (abs(l - {lum('r', 'g', 'b')}) >= 70), 5)::INTEGER AS steps FROM s GROUP BY id, r, g, b""",
    "f20_names_and_cuts": "SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', '') AS base, left(url, 40) AS cut, 'Translate ' || url || ' (page ' || page_id || ').' AS prompt, base64(url::BLOB) AS b64 FROM pages",
    "f25_time_budget": f"WITH {LINES}, b AS (SELECT book, count(DISTINCT page) * 17 AS n, count(DISTINCT page) AS p, count(*) AS l FROM lines GROUP BY book) SELECT book, {BUDGET.format(k=1)} AS once, {BUDGET.format(k=2)} AS proofread, greatest(1, least(99, floor(p * 99.0 / greatest(l, 1))))::INTEGER AS percent FROM b",
    "t02_stall_detection": """WITH e AS (SELECT user_id, epoch(ts)::BIGINT AS s FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events)), g AS (SELECT user_id, s, s - lag(s) OVER (PARTITION BY user_id ORDER BY s) AS gap FROM e),
      j AS (SELECT user_id, count(*) AS beats, coalesce(max(gap), 0) AS longest_gap, max(s) - min(s) AS elapsed FROM g GROUP BY user_id)
      SELECT *, CASE WHEN elapsed > 27 * 86400 THEN 'over time' WHEN longest_gap > 3 * 86400 THEN 'stalled' ELSE 'alive' END AS verdict FROM j""",
    "l01_mock_translate": f"SELECT doc_id AS id, md5(CASE WHEN regexp_matches(x, '\\p{{L}}') THEN '[' || x || ']' ELSE x END) AS target_md5 FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)",
    "l03_glossary_filter": f"SELECT term, (array_agg(value ORDER BY ord DESC))[1] AS value FROM {I.sql(I.GLOSSARY)} WHERE length(term) BETWEEN 2 AND 60 AND length(value) BETWEEN 1 AND 80 AND NOT ({garbled('term')}) AND NOT ({garbled('value')}) GROUP BY term",
    "s01_block_transform": f"SELECT * FROM (SELECT block::BIGINT AS block, {strip(chr(39).join(['replace(regexp_replace(text, ', '-', ' || chr(10) || ', '([а-яёїієґ])', ', ', chr(92) + '1', ', ', 'g', '), chr(10), ', ' ', ')']))} AS text FROM {I.sql(I.SPANS)} WHERE kind = 0) WHERE text <> '' UNION ALL SELECT doc_id + 1000, md5({strip('replace(text, chr(10), chr(32))')}) FROM documents",
    "s03_first_pages": f"WITH {LINES} SELECT book, page, sum(length(text))::BIGINT AS chars, count(*) AS lines FROM lines WHERE page < 6 GROUP BY ALL",
    "s04_ocr_cleanup": f"""WITH {LINES}, t AS (SELECT book, page, line_no, text FROM {V(L.TOC)} UNION ALL SELECT book, page, line_no, text FROM lines)
      SELECT book, page, line_no, md5(trim(regexp_replace(regexp_replace(text, '(?m)\\.{{2,}}.*$', '', 'g'), '\\s+', ' ', 'g'), ' .')) AS text_md5 FROM t""",
    "s05_ocr_line_order": f"WITH {LINES} SELECT book, page, line_no, (row_number() OVER (PARTITION BY book, page ORDER BY round_even(y0 / 5, 0), x0, line_no) - 1)::INTEGER AS by_five, (row_number() OVER (PARTITION BY book, page ORDER BY round_even(y0 / 4, 0), x0, line_no) - 1)::INTEGER AS by_four FROM lines",
    "s08_image_classes": f"WITH {BOXES}, s AS (SELECT id, round((x1 - x0) * (y1 - y0) / (420 * page_h), 8) AS share FROM boxes WHERE image) SELECT *, CASE WHEN share >= 0.5::DOUBLE THEN 'page' WHEN share >= 0.02::DOUBLE THEN 'inflow' ELSE 'small' END AS class FROM s",
    "s09_scan_lines": f"WITH {LINES} SELECT book, count(*) AS lines, sum({hits('text', chr(92) + 'p{L}')})::BIGINT AS letters, sum({hits('text', chr(92) + 'p{Nd}')})::BIGINT AS digits, sum({hits('text', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 's]')})::BIGINT AS signs FROM lines WHERE length(text) >= 4 GROUP BY book",
    "s10_size_guard": "SELECT doc_id, n_chars, CASE WHEN n_chars > 5250 THEN 'rejected early' WHEN n_chars > 5000 THEN 'rejected' ELSE 'accepted' END AS verdict FROM documents",
    "s16_font_lookup": f"WITH {LINES} SELECT book, page, line_no, CASE WHEN line_no % 2 = 0 THEN 'serif' ELSE 'sans' END || CASE WHEN size >= 15 THEN '-bold' ELSE '' END || CASE WHEN line_no % 5 = 0 THEN '-italic' ELSE '' END AS font FROM lines",
    "k02_page_plan": f"WITH {LINES} SELECT book, page // 40 AS chunk, page, count(*) AS live, max(line_no) AS last_line FROM (SELECT *, {TARGET02} AS target FROM lines) WHERE trim(target) <> '' AND NOT ({garbled('text')}) AND NOT ({garbled('target')}) GROUP BY ALL",
    "k03_overlay_plan": f"WITH {LINES} SELECT book, page, line_no, CASE WHEN {lum('(line_no * 40 % 256)', '(line_no * 40 % 256)', '(line_no * 40 % 256)')} > 130 THEN 'black' ELSE 'white' END AS ink FROM lines WHERE line_no % 3 <> 0 AND line_no % 5 <> 0",
    "k04_book_plan": f"""WITH RECURSIVE {PARS}, {HEAD_PAGES} SELECT DISTINCT book, 'cover' AS section, 1 AS section_no, 0 AS page, 0::BIGINT AS par_no, book AS text FROM pars
      UNION ALL SELECT book, 'contents', 2, s.page::INTEGER, par_no::BIGINT, left(p.text, 90) FROM pars p JOIN heads_ s USING (book, par_no) WHERE s.own = p.page AND kind <> 'para' UNION ALL SELECT book, 'body', 3, page, par_no::BIGINT, md5(text) FROM pars""",
    "k08_template_rule": f"WITH {LINES} SELECT book, CASE WHEN count(*) <= 2 THEN 'centred' WHEN count(*) = 3 THEN 'top' ELSE 'band' END AS template, (array_agg(line_no ORDER BY length(text) DESC, line_no))[1] AS accent FROM lines WHERE page = 0 GROUP BY book",
    "k14_preview_rows": f"""WITH {IDS} SELECT book, page, line_no, id::BIGINT AS id, md5(to_json({{'id': id, 'page': page, 'size': trunc(size)::INTEGER, 'original': text, 'translated': CASE WHEN id % 3 = 0 THEN lower(text) ELSE text END}})::VARCHAR) AS row_md5 FROM ids""",
    "m03_pixel_bbox": """WITH v AS (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
      p AS (SELECT vec_id // 16 AS image, vec_id % 4 * 8 + i % 8 AS x, vec_id // 4 % 4 * 8 + i // 8 AS y, greatest(0, least(255, floor((e::DOUBLE + 1) * 128)))::INTEGER AS g FROM v),
      b AS (SELECT image * 6 + k AS block, image, (k * 3)::DOUBLE AS x0, (k * 2)::DOUBLE AS y0, (k * 3 + 4 + k * k)::DOUBLE AS x1, (k * 2 + 3 + k)::DOUBLE AS y1, 80 + k * 20 AS tr, 200 - k * 20 AS tb FROM (SELECT DISTINCT vec_id // 16 AS image FROM embeddings), range(6) t(k)),
      s AS (SELECT *, greatest(0, trunc(x0 - greatest(6, (x1 - x0) * 0.5::DOUBLE))) AS sl, greatest(0, trunc(y0 - greatest(6, (y1 - y0) * 0.35::DOUBLE))) AS st, least(32, trunc(x1 + greatest(6, (x1 - x0) * 0.5::DOUBLE))) AS sr, least(32, trunc(y1 + greatest(6, (y1 - y0) * 0.35::DOUBLE))) AS sb FROM b),
      k AS (SELECT block, min(x) AS l, min(y) AS t, max(x) + 1 AS r, max(y) + 1 AS d, count(*) AS n FROM s JOIN p ON p.image = s.image AND x >= sl AND x < sr AND y >= st AND y < sb WHERE sr - sl >= 4 AND sb - st >= 4 AND (abs(g - tr) * 299 + abs(255 - g - 128) * 587 + abs(g - tb) * 114) // 1000 <= 48 GROUP BY block),
      g AS (SELECT b.*, k.* EXCLUDE (block), coalesce(n >= 25 AND NOT (r <= x0 OR l >= x1 OR d <= y0 OR t >= y1) AND (r - l) * (d - t) <= 4 * greatest((x1 - x0) * (y1 - y0), 1), false) AS good FROM b LEFT JOIN k USING (block))
      SELECT block, CASE WHEN good THEN l ELSE x0 END::DOUBLE AS x0, CASE WHEN good THEN t ELSE y0 END::DOUBLE AS y0, CASE WHEN good THEN r ELSE x1 END::DOUBLE AS x1, CASE WHEN good THEN d ELSE y1 END::DOUBLE AS y1 FROM g""",
    "j14_heading_pages": f"WITH RECURSIVE {PARS}, {HEAD_PAGES} SELECT book, own::BIGINT AS page, par_no::BIGINT AS par_no, page::BIGINT AS found FROM heads_",
    "l02_proofread": f"SELECT doc_id AS id, md5(CASE WHEN text IS NULL THEN '' WHEN length(text) % 2 = 0 THEN {strip("'~' || text || '.'")} ELSE '~' || text END) AS target_md5 FROM documents",
    "l05_cover_chain": f"""WITH {LINES}, n AS (SELECT n_name AS orig, '<' || n_name || '>' AS value, n_nationkey AS ord FROM nation UNION ALL SELECT p_name, '{{' || p_name || '}}', min(p_partkey) + 100 FROM part GROUP BY p_name),
      r AS (SELECT book, line_no::BIGINT AS line_no, text AS name FROM lines WHERE page = 0 AND length(text) BETWEEN 2 AND 59 UNION ALL SELECT 'nations', n_nationkey, left(n_name, 2) || 'q' || substr(n_name, 4) FROM nation
        UNION ALL SELECT 'parts', p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(left(p_name, 2) || 'q' || substr(p_name, 4)) WHEN 1 THEN left(p_name, 2) || 'q' || substr(p_name, 4) || ' - ' || left(p_brand, 2) || 'q' || substr(p_brand, 4) ELSE p_name END FROM part),
      w AS (SELECT lower(word) AS lw, arg_min(word, ord) AS word, min(ord) AS ord FROM (SELECT ord, unnest(regexp_extract_all(orig, {q(T.WORD)})) AS word FROM n) WHERE length(word) >= 2 GROUP BY lower(word)),
      t AS (SELECT book, line_no, name, unnest(regexp_extract_all(name, {q(T.WORD + '|' + T.NO_WORD)})) AS token, generate_subscripts(regexp_extract_all(name, {q(T.WORD + '|' + T.NO_WORD)}), 1) AS k FROM r),
      d AS (SELECT token, arg_min((levenshtein({one_byte('lower(token)')}, lw), word), (levenshtein({one_byte('lower(token)')}, lw), ord)) AS best FROM (SELECT DISTINCT token FROM t WHERE length(token) >= 2 AND {like('token', '^' + T.WORD)}), w GROUP BY token),
      f AS (SELECT book, line_no, name, string_agg(CASE WHEN (best[1] = 1 AND length(token) >= 2) OR (best[1] = 2 AND length(token) >= 4) THEN CASE WHEN token = upper(token) THEN upper(best[2]) ELSE best[2] END ELSE token END, '' ORDER BY k) AS fixed FROM t LEFT JOIN d USING (token) GROUP BY ALL),
      o AS (SELECT fixed, arg_min(value, ord) AS value FROM (SELECT DISTINCT fixed, lower(regexp_replace({strip('fixed')}, '\\s+', ' ', 'g')) AS norm FROM f), n WHERE length(norm) >= 3 AND (norm = lower(orig) OR (length(norm) >= 6 AND levenshtein({one_byte('norm')}, lower(orig)) <= 2)) GROUP BY fixed)
      SELECT book, line_no, coalesce(value, '[' || fixed || ']') AS shown, fixed <> name AS changed FROM f LEFT JOIN o USING (fixed)""",
    "t04_resumed": "SELECT doc_id AS id, md5(CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'saved ' || doc_id WHEN regexp_matches(x, '\\p{L}') THEN '[' || x || ']' ELSE x END) AS target_md5 FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)",
    "t10_rebuild": f"""WITH {PARS}, x AS (SELECT text, min((page, par_no)) AS came, arg_max(CASE WHEN par_no % 5 = 3 THEN ' ' ELSE 'T:' || page || ':' || par_no END, (page, par_no)) AS target FROM pars WHERE page % 3 = 0 GROUP BY text),
      c AS (SELECT {key('text')} AS k, arg_max(target, came) AS target FROM x WHERE trim(target) <> '' AND {strip('text')} <> '' GROUP BY ALL)
      SELECT book, page, par_no::BIGINT AS par_no, c.k IS NOT NULL AS cached, md5(coalesce(c.target, text)) AS target_md5 FROM pars LEFT JOIN c ON c.k = {key('text')}""",
    "p14_scanned_override": f"WITH {LINES}, b AS (SELECT book, count(DISTINCT page) AS n, sum(length(text)) AS c FROM lines GROUP BY book) SELECT book, (n >= 3 AND c < 2400 * n) OR (book IN ('src1', 'src3', 'src5') AND c < 4000 * greatest(n, 1)) AS scanned FROM b",
    "p27_cover_gate": f"""WITH d AS (SELECT book, doc_id, text FROM {L.values(L.COVER_PAGES)} UNION ALL SELECT source, doc_id, text FROM documents),
      p AS (SELECT book, (row_number() OVER (PARTITION BY book ORDER BY doc_id) - 1)::INTEGER AS page, doc_id, len([x FOR x IN string_split(coalesce(text, ''), chr(10)) IF {strip('x')} <> '']) AS blocks FROM d)
      SELECT book, page, doc_id, blocks, page = 0 AND blocks = 0 AND doc_id % 5 <> 0 AS remake FROM p""",
    "k15_downloads": f"SELECT job_id, path FROM {I.sql(I.JOBS)} WHERE status = 'done' AND length(path) > 0",
    "w09_line_pitch": f"WITH {LINES} SELECT book, page, round(CASE WHEN count(*) > 1 THEN greatest(1.05::DOUBLE, least(2.0::DOUBLE, (max(y0) - min(y0)) / (count(*) - 1) / avg(y1 - y0))) ELSE 1.15::DOUBLE END, 6) AS pitch FROM lines GROUP BY ALL",
    "o04_image_order": f"WITH {BOXES} SELECT book, page, id::BIGINT AS id, row_number() OVER (PARTITION BY book, page ORDER BY y0, id)::BIGINT AS place FROM boxes WHERE image",
    "f19_join_split": f"WITH {LINES}, p AS (SELECT book, page, string_agg(text, {q(L.DELIMITER)} ORDER BY line_no) AS sent, count(*) AS n FROM lines GROUP BY ALL) SELECT book, page, md5(sent) AS sent_md5, n, len(string_split(sent, {q(L.DELIMITER.strip())})) = n AS whole FROM p",
    "f23_glossary_text": f"SELECT string_agg(term || ' → ' || value, '; ' ORDER BY ord) AS glossary FROM (SELECT * FROM {I.sql(I.GLOSSARY)} WHERE length(value) > 0 ORDER BY ord LIMIT 60)",
    "o06_top_by_count": "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS token FROM documents) WHERE length(token) > 2 GROUP BY token ORDER BY n DESC, token LIMIT 60",
    "u04_seen_dedup": f"WITH {IDS} SELECT book, md5(text) AS key, min(id) AS first_id, count(*) AS n FROM ids GROUP BY book, text HAVING count(*) > 1",
    "u02_set_difference": "SELECT user_id, event_type FROM events EXCEPT ALL SELECT user_id, event_type FROM events WHERE value >= 20",
}
ORACLES |= {
    "t03_watchdog": """WITH e AS (SELECT user_id AS job, epoch_us(ts) AS us, greatest(1, least(99, floor(value * 99 / 100)))::INTEGER AS percent FROM events),
      g AS (SELECT *, CASE WHEN coalesce(percent <> lag(percent) OVER o, true) THEN us END AS went, lag(percent) OVER o AS last_percent FROM e WINDOW o AS (PARTITION BY job ORDER BY us, percent)),
      b AS (SELECT *, min(us) OVER o AS started, max(went) OVER o AS moved, max(us) OVER o AS last_beat, count(*) OVER o AS n FROM g WINDOW o AS (PARTITION BY job ORDER BY us, percent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      l AS (SELECT *, started + 20 * 86400000000 AS by_total, moved + 2 * 86400000000 AS by_idle FROM b)
      SELECT job, arg_min(last_beat, us) AS last_beat, arg_min(n, us) AS beats, arg_min(last_percent, us) AS percent, arg_min(CASE WHEN by_total <= by_idle THEN 'over time' ELSE 'stalled' END, us) AS verdict FROM l WHERE us > least(by_total, by_idle) GROUP BY job""",
    "t07_accepted_submits": "SELECT sha256(props) AS file_hash, event_type AS layout, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS submits FROM events GROUP BY props, event_type",
    "k09_checkpoint_commit": """SELECT d.doc_id AS id, md5(CASE WHEN l.doc_id IS NULL THEN CASE WHEN regexp_matches(x, '\\p{L}') THEN '[' || x || ']' ELSE x END WHEN quality = 1 OR length(l.doc_id::VARCHAR) < 3 THEN 'second ' || l.doc_id ELSE 'first ' || l.doc_id END) AS target_md5
      FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents) d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "w14_fitting_sizes": """WITH RECURSIVE t AS (SELECT p_partkey, string_split(p_name || ' ' || p_brand || ' ' || p_type, ' ') AS w, 8 + p_size % 17 AS size, 30 + p_partkey % 90 AS width, 10 + p_partkey % 37 AS height FROM part),
      h AS (SELECT *, unnest(range(ceil(greatest(6, size * 0.7::DOUBLE) * 2)::BIGINT, size * 2 + 1)) AS halves FROM t),
      c AS (SELECT p_partkey, w, halves, height, greatest(1, floor(width / (halves / 2 * 0.55::DOUBLE)))::INTEGER AS chars FROM h),
      f AS (SELECT p_partkey, halves, 0 AS k, 0 AS lines, 0 AS used FROM c UNION ALL
        SELECT f.p_partkey, f.halves, f.k + 1, CASE WHEN f.lines > 0 AND f.used + 1 + length(c.w[f.k + 1]) <= chars THEN f.lines ELSE f.lines + 1 END, CASE WHEN f.lines > 0 AND f.used + 1 + length(c.w[f.k + 1]) <= chars THEN f.used + 1 + length(c.w[f.k + 1]) ELSE length(c.w[f.k + 1]) END
        FROM f JOIN c USING (p_partkey, halves) WHERE f.k < len(c.w))
      SELECT p_partkey, coalesce(max(halves) FILTER (lines * (halves / 2) * 1.2::DOUBLE <= height), min(halves)) / 2 AS fits FROM f JOIN c USING (p_partkey, halves) WHERE f.k = len(c.w) GROUP BY p_partkey""",
    "a10_dominant_colours": f"""WITH c AS (SELECT id, r // 12 * 12 AS r, g // 12 * 12 AS g, b // 12 * 12 AS b, sum(n) AS n FROM {I.sql(I.PIXELS)} GROUP BY ALL),
      s AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY n DESC, r, g, b)::INTEGER AS place, least(255, r + 6)::INTEGER AS r, least(255, g + 6)::INTEGER AS g, least(255, b + 6)::INTEGER AS b, round(n / sum(n) OVER (PARTITION BY id)::DOUBLE, 6) AS share FROM c),
      k AS (SELECT * FROM s WHERE place <= 6)
      SELECT *, max(share) OVER (PARTITION BY id) > 0.5::DOUBLE AS plain,
        place = arg_min(place, (-round(abs({lum('r', 'g', 'b')} - 110), 6), place)) FILTER (place <= 3) OVER (PARTITION BY id) AS base,
        place = arg_min(place, (least(r, g, b) - greatest(r, g, b), place)) OVER (PARTITION BY id) AS accent FROM k""",
    "p18_image_areas": f"""WITH {BOXES}, t AS (SELECT * REPLACE (y1 + CASE WHEN image THEN 20 ELSE 0 END AS y1) FROM boxes),
      i AS (SELECT * FROM t WHERE image AND (x1 - x0) * (y1 - y0) > 0.05::DOUBLE * 420 * page_h * 0.2::DOUBLE)
      SELECT id::BIGINT AS id, EXISTS (SELECT 1 FROM i WHERE i.book = b.book AND i.page = b.page AND least(b.x1, i.x1) - greatest(b.x0, i.x0) > 0 AND least(b.y1, i.y1) - greatest(b.y0, i.y0) > 0
        AND (least(b.x1, i.x1) - greatest(b.x0, i.x0)) * (least(b.y1, i.y1) - greatest(b.y0, i.y0)) > 0.6::DOUBLE * greatest((b.x1 - b.x0) * (b.y1 - b.y0), 1)) AS painted FROM t b WHERE NOT image""",
}
ORACLES["t13_quality_flag"] = f"SELECT book, 'done' AS status, CASE WHEN has_issues THEN 'check' ELSE 'clean' END AS flag FROM ({ORACLES['a16_quality_report']})"
