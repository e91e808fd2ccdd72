"""The registered queries in DuckDB's SQL, written independently of the expressions: windows over exploded rows."""

from __future__ import annotations

from papyrine.functions import patterns as P
from papyrine.sources.views import BLOCKS_SQL, FILE_NAME, MARKDOWN_SQL

DAY = "20240101"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{P.WS}+|{P.WS}+$')}, '', 'g')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(P.WS + '+')}, ' ', 'g'), ' ')"


def extract(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def among(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


BLANK = f"[^{P.WS[1:]}"
MD = f"v AS ({MARKDOWN_SQL})"
LINES = f"{MD}, l AS (SELECT doc_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS pos FROM v)"
ROMAN_NUMERAL, ROMAN_TITLE = f"upper({extract('s', '(?i)' + P.ROMAN)})", f"trim({extract('s', '(?i)' + P.ROMAN, 2)}, ' .:-')"
ROMAN = f"CASE WHEN length(s) <= {P.ROMAN_LONGEST} AND {ROMAN_NUMERAL} <> '' AND length({ROMAN_TITLE}) >= 2 THEN {ROMAN_NUMERAL} || '. ' || {ROMAN_TITLE} END"
SPECIAL = "CASE WHEN rtrim(lower(s), ':.-') = 'abstract' THEN 'Abstract' END"
STRIPPED = f"{LINES}, t AS (SELECT *, {strip('line')} AS s FROM l)"


def heading(version: int) -> str:
    pattern = P.HEADER_V1 if version == 1 else P.HEADER_V2
    title = strip(extract("line", pattern))
    first = f"CASE WHEN regexp_matches(line, {q(pattern)}) THEN {title if version == 1 else f'nullif({title}, chr(0)[1:0])'} END"
    return f"coalesce({first}, {ROMAN}, {SPECIAL})"


def sections(version: int) -> str:
    """CTEs up to ``p``: (doc_id, sec, title, paragraphs) with the empty leading preamble dropped."""
    return f"""{STRIPPED}, h AS (SELECT doc_id, pos, line, {heading(version)} AS title FROM t),
n AS (SELECT *, sum(CASE WHEN title IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sec FROM h),
b AS (SELECT doc_id, sec, coalesce(max(title), 'Preamble') AS title, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (title IS NULL), '') AS body FROM n GROUP BY doc_id, sec),
p0 AS (SELECT doc_id, sec, title, list_filter(list_transform(regexp_split_to_array({strip('body')}, {q(P.PARAGRAPH_BREAK)}), lambda x: {strip('x')}), lambda x: x <> '') AS paragraphs FROM b),
p AS (SELECT * FROM p0 WHERE NOT (sec = 0 AND len(paragraphs) = 0))"""


CITED = f"CAST(coalesce(list_sum(list_transform(paragraphs, lambda x: len(regexp_extract_all(x, {q(P.CITATION)})))), 0) AS INT)"


def sections_out(version: int) -> str:
    keep = "" if version == 1 else f" WHERE lower({strip('title')}) NOT IN {among(P.EXCLUDED_SECTIONS)}"
    return f"""{sections(version)}, o AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec) AS VARCHAR) AS section_id, sec, title,
array_to_string(paragraphs, chr(10) || chr(10)) AS summary, {CITED} AS citation_count FROM p{keep})"""


BLOCK_TEXT = strip(extract("markdown", "(?i)" + P.REFERENCE_BLOCK + "$"))
REFERENCE_LINES = f"""{MD}, rb AS (SELECT doc_id, {BLOCK_TEXT} AS block FROM v),
rl AS (SELECT doc_id, unnest(string_split(block, chr(10))) AS line, generate_subscripts(string_split(block, chr(10)), 1) AS pos FROM rb),
rs AS (SELECT *, {strip('line')} AS v1, {strip(f"regexp_replace(line, {q(P.BULLET)}, '')")} AS v2 FROM rl WHERE regexp_matches(line, {q(BLANK)}))"""


def references(version: int) -> str:
    """CTEs up to ``r``: (doc_id, ref_id, raw)."""
    text = f"v{version}"
    cut = f"""{REFERENCE_LINES}, rc AS (SELECT *, min(pos) FILTER (regexp_matches({text}, {q('(?i)' + P.REFERENCE_STOP)})) OVER (PARTITION BY doc_id) AS stop FROM rs),
rt AS (SELECT * FROM rc WHERE stop IS NULL OR pos < stop)"""
    if version == 1:
        return f"{cut}, r AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS VARCHAR) AS ref_id, v1 AS raw FROM rt)"
    return f"""{cut}, ri AS (SELECT *, sum(CASE WHEN regexp_matches(line, {q(P.REFERENCE_START)}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS entry FROM rt),
r AS (SELECT doc_id, CAST(entry AS VARCHAR) AS ref_id, string_agg(v2, ' ' ORDER BY pos) AS raw FROM ri WHERE entry > 0 GROUP BY doc_id, entry)"""


def watermark(x: str) -> str:
    return f"regexp_matches({x}, {q('(?i)' + P.WATERMARK)})"


TITLES = f"""list_filter(list_transform(regexp_extract_all(left(markdown, {P.TITLE_REGION}), {q('(?m)' + P.TITLE)}, 1), lambda x: {strip(f"rtrim({strip('x')}, '#')")}),
lambda x: NOT {watermark('x')} AND lower(x) NOT IN {among(P.SKIP_TITLES)} AND length(x) >= {P.TITLE_LEAST})"""
PLAIN = f"""list_filter(list_transform(regexp_split_to_array(left(markdown, {P.TITLE_REGION}), {q(P.LINE_ENDS)}), lambda x: {strip(f"ltrim({strip('x')}, '#')")}),
lambda x: length(x) > {P.FALLBACK_LEAST} AND NOT {watermark('x')} AND NOT regexp_matches(x, {q(P.TITLE_REJECT)}))"""
PAPER_TITLE = f"left(coalesce(({TITLES})[1], ({PLAIN})[1], 'Untitled'), {P.TITLE_CUT})"
ORGANIZATION = f"left({strip(extract(f'left(markdown, {P.ORGANIZATION_REGION})', '(?i)' + P.ORGANIZATION))}, {P.ORGANIZATION_CUT})"


def abstract(version: int) -> str:
    region, cut = P.ABSTRACT_SIZES[version]
    return f"left({strip(extract(f'left(markdown, {region})', f'(?i){P.ABSTRACT_HEAD}((?s:.+?))(?:{P.ABSTRACT_END})'))}, {cut})"


def _number(text: str, pattern: str, group: int) -> str:
    return f"TRY_CAST({extract(text, '(?i)' + pattern, group)} AS INT)"


HEAD, FAR = f"left(markdown, {P.DATE_REGION})", f"left(markdown, {P.CONFERENCE_REGION})"
MEETING = f"(?:^|[^\\p{{L}}\\p{{N}}_]){P.CONFERENCE}(?:$|[^\\p{{L}}\\p{{N}}_])"
MONTH_OF = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in P.CONFERENCE_MONTHS.items())
DAY_OF = lambda y, m, d: f"CAST({y} AS VARCHAR) || '-' || lpad(CAST({m} AS VARCHAR), 2, '0') || '-' || lpad(CAST({d} AS VARCHAR), 2, '0')"
PUBLISH_DATE = f"""WITH {MD}, x AS (SELECT doc_id, {_number(HEAD, P.DATE_LABELLED, 1)} AS a, {_number(HEAD, P.DATE_LABELLED, 2)} AS b, {_number(HEAD, P.DATE_LABELLED, 3)} AS y,
{_number(HEAD, P.DATE_ISO, 1)} AS iy, {_number(HEAD, P.DATE_ISO, 2)} AS im, {_number(HEAD, P.DATE_ISO, 3)} AS id,
list_position([{', '.join(map(q, P.MONTHS))}], lower({extract(HEAD, '(?i)' + P.DATE_WORDS)})) AS wm, {_number(HEAD, P.DATE_WORDS, 2)} AS wy,
CASE lower({extract(FAR, '(?i)' + MEETING)}) {MONTH_OF} ELSE 1 END AS cm, {_number(FAR, MEETING, 2)} AS cy FROM v)
SELECT doc_id, CASE WHEN y > 1900 AND y < 2100 AND a > 12 AND b BETWEEN 1 AND 12 AND a BETWEEN 1 AND 31 THEN {DAY_OF('y', 'b', 'a')}
WHEN y > 1900 AND y < 2100 AND NOT a > 12 AND b > 12 AND a BETWEEN 1 AND 12 AND b BETWEEN 1 AND 31 THEN {DAY_OF('y', 'a', 'b')}
WHEN im BETWEEN 1 AND 12 AND id BETWEEN 1 AND 31 THEN {DAY_OF('iy', 'im', 'id')}
WHEN wm > 0 AND wy > 1900 AND wy < 2100 THEN {DAY_OF('wy', 'wm', '1')} WHEN cy > 1990 AND cy < 2100 THEN {DAY_OF('cy', 'cm', '1')} ELSE '' END AS publish_date FROM x"""

OPAQUE = "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
CLEAN = f"regexp_replace(html, {q(OPAQUE)}, '', 'g')"
ANCHOR = "(?is)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s>\"']+))[^>]*>(.*?)</a>"


def links(html: str = "html") -> str:
    """CTEs c (page_id, url, clean) and k (page_id, url, href, inner_html, pos)."""
    clean = CLEAN.replace("html,", f"{html},", 1)
    group = lambda i: f"regexp_extract(m, {q(ANCHOR)}, {i})"
    return f"""c AS (SELECT page_id, url, {clean} AS clean FROM pages),
m AS (SELECT page_id, url, unnest(regexp_extract_all(clean, {q(ANCHOR)})) AS m, generate_subscripts(regexp_extract_all(clean, {q(ANCHOR)}), 1) - 1 AS pos FROM c),
k AS (SELECT page_id, url, {unescape(f'{group(1)} || {group(2)} || {group(3)}')} AS href, {group(4)} AS inner_html, pos FROM m)"""


#: The entities that the test pages have.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&")]


def unescape(x: str) -> str:
    for entity, character in ENTITIES:
        x = f"replace({x}, {q(entity)}, {q(character)})"
    return x


LINKS = links()


def text_of(x: str) -> str:
    return unescape(f"regexp_replace({x}, '<[^>]*>', '', 'g')")


def elements(tag: str, attribute: str | None = None, value: str | None = None) -> str:
    extra = rf"""\s(?:[^>]*?\s)?{attribute}=(?:"(?:[^"]* )?{value}(?: [^"]*)?"|'(?:[^']* )?{value}(?: [^']*)?'|{value})(?:\s[^>]*)?""" if attribute else r"(?:\s[^>]*)?"
    return f"regexp_extract_all(clean, {q(f'(?is)<{tag}{extra}>(.*?)</{tag}>')}, 1)"


PAGE = f"c AS (SELECT page_id, url, {CLEAN} AS clean FROM pages)"
SITE = extract("url", r"^([^?#]*?//[^/?#]*)")
FOLDER = f"CASE WHEN regexp_matches({extract('url', r'^([^?#]*//[^/?#]*(?:[^?#]*/)?)')}, '/$') THEN {extract('url', r'^([^?#]*//[^/?#]*(?:[^?#]*/)?)')} ELSE {extract('url', r'^([^?#]*//[^/?#]*(?:[^?#]*/)?)')} || '/' END"
RESOLVED = f"""CASE WHEN href = '' THEN url WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href
WHEN starts_with(href, '//') THEN {extract('url', r'^([a-zA-Z][a-zA-Z0-9+.-]*):')} || ':' || href WHEN starts_with(href, '/') THEN {SITE} || href
WHEN starts_with(href, '#') THEN {extract('url', r'^([^#]*)')} || href WHEN starts_with(href, '?') THEN {extract('url', r'^([^?#]*)')} || href ELSE {FOLDER} || href END"""
STEM = "regexp_replace(list_last(string_split(path, '/')), '(.)[.][^.]+$', '\\1')"
BLOCKS = f"d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), k AS ({BLOCKS_SQL} FROM d)"
PAPER_NAMES = f"n AS (SELECT page_id, url, {strip(text_of(f'({elements('title')})[1]'))} AS paper_name FROM c)"


def to_roman() -> str:
    digit = lambda place, names: f"[{', '.join(map(q, names))}][(n // {place}) % 10 + 1]"
    hundreds = ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]
    tens = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]
    ones = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
    return f"SELECT doc_id, repeat('M', n // 1000) || {digit(100, hundreds)} || {digit(10, tens)} || {digit(1, ones)} AS roman FROM (SELECT doc_id, greatest(doc_id, 1) AS n FROM documents)"


#: Sentences' TF-IDF cosines from 0.1 up are links, a sentence without words leads everywhere; a hundred damped steps.
LEXRANK = f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: {squeeze('x')}), lambda x: x <> '') AS s FROM documents),
e AS (SELECT doc_id, len(s) AS n, CAST(generate_subscripts(s, 1) AS INT) AS pos, unnest(s) AS sentence FROM d),
w AS (SELECT doc_id, n, pos, unnest(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}]+')) AS word FROM e),
tf AS (SELECT doc_id, n, pos, word, count(*) AS c FROM w GROUP BY ALL),
raw AS (SELECT doc_id, pos, word, c * (ln(n / count(*) OVER (PARTITION BY doc_id, word)) + 1) AS x FROM tf),
unit AS (SELECT doc_id, pos, word, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id, pos)) AS x FROM raw),
near AS (SELECT a.doc_id, a.pos AS a, b.pos AS b FROM unit a JOIN unit b USING (doc_id, word) GROUP BY ALL HAVING sum(a.x * b.x) >= 0.1),
every AS (SELECT doc_id, a, b FROM near UNION ALL SELECT e.doc_id, e.pos, o.pos FROM e ANTI JOIN w USING (doc_id, pos) JOIN e o USING (doc_id)),
walk AS MATERIALIZED (SELECT doc_id, a, b, 0.85 / count(*) OVER (PARTITION BY doc_id, a) AS share FROM every),
r AS (SELECT 0 AS step, doc_id, pos, n, CAST(1 AS DOUBLE) / n AS rank FROM e
UNION ALL SELECT r.step + 1, r.doc_id, walk.b, r.n, CAST(0.15 AS DOUBLE) / r.n + sum(r.rank * walk.share) FROM r JOIN walk ON walk.doc_id = r.doc_id AND walk.a = r.pos WHERE r.step < 100 GROUP BY r.step, r.doc_id, walk.b, r.n),
best AS (SELECT doc_id, pos FROM r WHERE step = 100 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(rank, 9) DESC, pos) <= 2),
told AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM best JOIN e USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, summary FROM documents LEFT JOIN told USING (doc_id)"""

ORACLE = {
    "scan_documents": "SELECT doc_id, lang, source, length(text) AS n_characters FROM documents WHERE n_chars > 500",
    "html_title": f"WITH {PAGE} SELECT page_id, {strip(text_of(f'({elements('title')})[1]'))} AS title FROM c",
    "html_links": f"WITH {LINKS} SELECT page_id, CAST(pos AS INT) AS pos, href, {squeeze(text_of('inner_html'))} AS anchor FROM k",
    "html_class_div": f"WITH {PAGE} SELECT page_id, {strip(text_of(f'({elements('div', 'class', 'ad')})[1]'))} AS ad FROM c",
    "html_text": f"WITH {PAGE} SELECT page_id, {text_of(f'({elements('h1')})[1]')} AS raw, {squeeze(text_of(f'({elements('article')})[1]'))} AS article FROM c",
    "first_matching_link": f"WITH {LINKS} SELECT page_id, min_by(href, pos) AS href FROM k WHERE regexp_matches(href, '/[a-z]+$') GROUP BY page_id",
    "href_prefix_filter": f"WITH {LINKS} SELECT page_id, CAST(pos AS INT) AS pos, href FROM k WHERE starts_with(href, '/') AND NOT contains(href, '#')",
    "href_regex_filter": f"WITH {LINKS} SELECT page_id, CAST(pos AS INT) AS pos, href FROM k WHERE regexp_matches(href, '^/[a-z]+[0-9]*/?$')",
    "squeeze_title": f"SELECT doc_id, {squeeze(r"replace('Title: ' || text, 'Title:', '')")} AS title FROM documents",
    "url_resolve": f"WITH {LINKS} SELECT page_id, CAST(pos AS INT) AS pos, {RESOLVED} AS resolved FROM k",
    "url_year": f"SELECT page_id, coalesce(nullif({extract('url', '((?:19|20)[0-9]{2})')}, ''), 'Unknown') AS year FROM pages",
    "event_year": "SELECT page_id, replace(list_last(string_split(url, '-')), '/', '') AS year FROM pages",
    "conf_type": "SELECT page_id, CASE WHEN contains(lower(url), 'workshop') THEN 'workshop' ELSE 'main conference' END AS kind FROM pages",
    "clean_text": f"SELECT doc_id, {squeeze('text')} AS text FROM documents WHERE regexp_matches(text, {q(BLANK)})",
    "merge_blocks": f"""WITH {BLOCKS}, g AS (SELECT *, row_number() OVER w AS place, coalesce(abs(y0 - lag(y1) OVER w) >= 10, true) AS start FROM k WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, block_idx)),
s AS (SELECT *, sum(CASE WHEN start THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY place ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT doc_id, page, CAST(island AS BIGINT) AS island, min_by(x0, place) AS x0, min_by(y0, place) AS y0, max(x1) AS x1, max_by(y1, place) AS y1, string_agg(text, ' ' ORDER BY place) AS text FROM s GROUP BY doc_id, page, island""",
    "block_union": f"""WITH {BLOCKS} SELECT doc_id, page, block_idx, text, 'text' AS type, CAST(NULL AS VARCHAR) AS image_path FROM k
UNION ALL SELECT doc_id, 0, NULL, NULL, 'figure', 'images/' || lang || '.png' FROM documents""",
    "top_blocks": f"WITH {BLOCKS} SELECT doc_id, page, block_idx, y0, text FROM k ORDER BY doc_id, page, y0, block_idx LIMIT 10",
    "md_lines": f"WITH {LINES} SELECT doc_id, CAST(pos - 1 AS INT) AS pos, line FROM l",
    "md_headers": f"WITH {LINES} SELECT doc_id, CAST(pos - 1 AS INT) AS pos, {strip(extract('line', P.HEADER_V1))} AS v1, {strip(extract('line', P.HEADER_V2))} AS v2 FROM l WHERE regexp_matches(line, {q(P.HEADER_V1)})",
    "roman_headers": f"WITH {STRIPPED} SELECT doc_id, CAST(pos - 1 AS INT) AS pos, {ROMAN} AS title FROM t WHERE {ROMAN} IS NOT NULL",
    "special_headers": f"WITH {STRIPPED} SELECT doc_id, CAST(pos - 1 AS INT) AS pos, {SPECIAL} AS title FROM t WHERE {SPECIAL} IS NOT NULL",
    "sections_v1": f"WITH {sections_out(1)} SELECT doc_id, section_id, title, summary, citation_count > 0 AS has_citation, citation_count FROM o",
    "sections_v2": f"WITH {sections_out(2)} SELECT doc_id, section_id, title, summary, citation_count > 0 AS has_citation, citation_count FROM o",
    "paragraphs": f"""WITH {sections(1)}, e AS (SELECT doc_id, CAST(sec AS INT) AS section_no, unnest(paragraphs) AS text, CAST(generate_subscripts(paragraphs, 1) AS INT) AS paragraph_id FROM p)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, paragraph_id) AS place, paragraph_id, text, len(regexp_extract_all(text, {q(P.CITATION)})) > 0 AS is_citation,
array_to_string(regexp_extract_all(text, {q(P.CITATION)}), '|') AS citations FROM e""",
    "section_text": f"WITH {sections_out(2)} SELECT doc_id, title, max(length(summary)) AS longest FROM o GROUP BY doc_id, title",
    "section_citations": f"WITH {sections_out(1)} SELECT doc_id, sum(citation_count) AS citations, count(*) FILTER (citation_count > 0) AS cited_sections FROM o GROUP BY doc_id",
    "citations": f"WITH {MD} SELECT doc_id, len(regexp_extract_all(markdown, {q(P.CITATION)})) AS n, array_to_string(regexp_extract_all(markdown, {q(P.CITATION)}), '|') AS found FROM v",
    "paper_title": f"WITH {MD} SELECT doc_id, {PAPER_TITLE} AS title FROM v",
    "watermark_filter": f"WITH {LINES} SELECT doc_id, CAST(pos - 1 AS INT) AS pos, line FROM l WHERE {watermark('line')}",
    "organization": f"WITH {MD} SELECT doc_id, {ORGANIZATION} AS organization FROM v",
    "publish_date": PUBLISH_DATE,
    "abstract_v1": f"WITH {MD} SELECT doc_id, {abstract(1)} AS abstract FROM v",
    "abstract_v2": f"WITH {MD} SELECT doc_id, {abstract(2)} AS abstract FROM v",
    "doc_ids": f"WITH f AS (SELECT doc_id, {FILE_NAME} AS path FROM documents) SELECT doc_id, 'paper_' || regexp_replace({STEM}, '[^a-zA-Z0-9_]', '_', 'g') || '_{DAY}' AS paper_id, {STEM} || '_processed.json' AS file FROM f",
    "sanitize_names": f"""WITH f AS (SELECT doc_id, regexp_replace(' ' || {FILE_NAME} || text, '[^\\p{{L}}\\p{{N}} _-]', '', 'g') AS name FROM documents)
SELECT doc_id, 'papers/2020_' || left({strip('name')}, 150) || '.pdf' AS trimmed, left(name, 150) AS untrimmed FROM f""",
    "to_roman": to_roman(),
    "leading_roman": f"WITH {STRIPPED} SELECT doc_id, CAST(pos - 1 AS INT) AS pos, upper({extract('s', '(?i)^([IVXLCDM]+)(?:$|[^\\p{L}\\p{N}_])')}) AS roman FROM t WHERE regexp_matches(s, '(?i)^[IVXLCDM]+(?:$|[^\\p{{L}}\\p{{N}}_])')".replace("{{", "{").replace("}}", "}"),
    "reference_block": f"WITH {MD} SELECT doc_id, {BLOCK_TEXT} AS block FROM v",
    "references_v1": f"WITH {references(1)} SELECT doc_id, ref_id, raw FROM r",
    "references_v2": f"WITH {references(2)} SELECT doc_id, ref_id, raw FROM r",
    "sentences": f"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: {squeeze('x')}), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS pos, unnest(s) AS sentence FROM s""",
    "lexrank": LEXRANK,
    "corpus_stats": f"""WITH {sections_out(2)}, {references(2).removeprefix(MD + ', ')}, a AS (SELECT count(*) AS n_documents, count(*) FILTER ({abstract(2)} <> '') AS n_abstracts FROM v)
SELECT n_documents, (SELECT count(*) FROM o) AS n_sections, (SELECT count(*) FROM r) AS n_references, (SELECT sum(citation_count) FROM o) AS n_citations, n_abstracts FROM a""",
    "processed_document": f"""WITH {sections_out(2)}, {references(2).removeprefix(MD + ', ')},
so AS (SELECT doc_id, string_agg(section_id || '|' || title || '|' || CAST(citation_count AS VARCHAR), chr(10) ORDER BY sec) AS sections FROM o GROUP BY doc_id),
ro AS (SELECT doc_id, string_agg(ref_id || '|' || raw, chr(10) ORDER BY CAST(ref_id AS INT)) AS refs FROM r GROUP BY doc_id)
SELECT v.doc_id, {PAPER_TITLE} AS title, {abstract(2)} AS abstract, coalesce(sections, '') AS sections, coalesce(refs, '') AS refs FROM v LEFT JOIN so USING (doc_id) LEFT JOIN ro USING (doc_id)""",
    "distinct_links": f"WITH {LINKS} SELECT DISTINCT href FROM k",
    "link_expand": f"""WITH {LINKS} SELECT DISTINCT page_id, href, {SITE} || href AS target FROM k WHERE starts_with(href, '/')""",
    "crawl_levels": f"""WITH {LINKS}, e AS (SELECT DISTINCT page_id % 40 AS u, (page_id * 7 + pos * 3 + length(href)) % 40 AS t FROM k)
SELECT DISTINCT a.u AS event, a.t AS volume, b.t AS paper FROM e a JOIN e b ON b.u = a.t WHERE a.u < 5 AND a.t >= 5 AND b.t % 2 = 0""",
    "proceedings_papers": f"""WITH {PAGE}, z AS (SELECT page_id, url, unnest({elements('li')}) AS li FROM c), y AS (SELECT page_id, {strip(text_of('li'))} AS paper_name, coalesce(nullif({extract('url', '((?:19|20)[0-9]{2})')}, ''), 'Unknown') AS year, {SITE} AS site FROM z)
SELECT page_id, paper_name, year, 'IJCAI ' || year AS conference_name, site || '/p' || paper_name || '.pdf' AS pdf_url FROM y""",
    "href_substring": f"WITH {LINKS} SELECT page_id, CAST(pos AS INT) AS pos, href FROM k WHERE href LIKE '%an%'",
    "paper_id_links": f"""WITH {LINKS} SELECT DISTINCT page_id, 'https://a.example/P' || CAST(page_id % 100 AS VARCHAR) || '-' || CAST(pos + 1000 AS VARCHAR) || CASE WHEN pos % 4 = 0 THEN '/' ELSE '' END AS paper
FROM k WHERE pos % 2 = 0 UNION SELECT DISTINCT page_id, 'https://a.example' || href FROM k WHERE pos % 2 = 1 AND regexp_matches(href, '^/[A-Z][0-9]+-[0-9]+/?$')""",
    "url_resolve_dots": f"""WITH {LINKS} SELECT page_id, CAST(pos AS INT) AS pos, {SITE} || coalesce(nullif(regexp_replace({extract('url', '^[^?#]*?//[^/?#]*((?:[^?#]*/)?)')}, '[^/]*/$', ''), ''), '/') || 'x/' || substr(href, 2) || '?q=../z' AS resolved FROM k WHERE starts_with(href, '/')""",
    "html_class_tokens": f"""WITH {PAGE} SELECT page_id, CASE WHEN page_id % 4 < 3 THEN {strip(text_of(f'({elements('div', 'class', 'ad')})[1]'))} END AS ad FROM c""",
    "html_single_quoted_links": f"""WITH {LINKS} SELECT page_id, CAST(pos AS INT) AS pos, CASE WHEN starts_with(href, '/t') THEN '/T&' || substr(href, 3) ELSE href END AS href, {squeeze(text_of('inner_html'))} AS anchor FROM k""",
    "html_footer": f"""WITH {PAGE} SELECT page_id, {text_of(f'({elements('footer')})[1]')} AS footer,
array_to_string(list_transform(regexp_split_to_array(({elements('article')})[1], '<[^>]*>'), lambda x: {strip(unescape('x'))}), '') AS article FROM c""",
    "empty_sections": f"""WITH {sections(1)}, e AS (SELECT doc_id, sec, title FROM p WHERE len(paragraphs) = 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS INT) AS pos, title FROM e""",
    "resume_anti_join": f"""WITH {PAGE}, {PAPER_NAMES}, f AS (SELECT paper_name, min(page_id) AS page_id FROM n WHERE page_id % 3 <> 0 GROUP BY paper_name)
SELECT f.paper_name, f.page_id FROM f WHERE paper_name IS NOT NULL AND paper_name NOT IN (SELECT paper_name FROM n WHERE page_id % 3 = 0 AND paper_name IS NOT NULL)""",
    "resume_path_join": "WITH p AS (SELECT page_id, 'papers/' || list_last(string_split(url, '/')) || '.pdf' AS paper_path FROM pages) SELECT page_id, paper_path FROM p WHERE page_id % 3 <> 0 AND paper_path NOT IN (SELECT paper_path FROM p WHERE page_id % 3 = 0)",
    "zip_join": f"""WITH {PAGE}, z AS (SELECT page_id, {elements('li')} AS a, {elements('p')} AS b FROM c), y AS (SELECT page_id, unnest(range(0, least(len(a), len(b)))) AS i, a, b FROM z)
SELECT page_id, CAST(i AS INT) AS pos, a[i + 1] AS first, b[i + 1] AS second FROM y""",
    "listing_pages": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS listing_page FROM documents",
    "papers_union": f"""WITH {PAGE}, {PAPER_NAMES}, u AS (SELECT paper_name, NULL AS year, NULL AS conference_name, NULL AS workshop_or_main_conference, 'a/' || CAST(page_id AS VARCHAR) AS paper_path FROM n WHERE page_id % 3 = 0
UNION ALL SELECT paper_name, CAST(1990 + page_id % 30 AS VARCHAR), 'ACL', CASE WHEN contains(lower(url), 'workshop') THEN 'workshop' ELSE 'main conference' END, 'b/' || CAST(page_id AS VARCHAR) FROM n WHERE page_id % 3 = 1
UNION ALL SELECT paper_name, coalesce(nullif({extract('url', '((?:19|20)[0-9]{2})')}, ''), 'Unknown'), 'IJCAI ' || coalesce(nullif({extract('url', '((?:19|20)[0-9]{2})')}, ''), 'Unknown'), 'main', 'c/' || CAST(page_id AS VARCHAR) FROM n WHERE page_id % 3 = 2)
SELECT *, TRY_CAST(year AS INT) AS year_int FROM u""",
}
