"""DuckDB oracle SQL: the same semantics written independently as SQL text.

Each registered query has its SQL twin here (driver check at sf0.01). The
SQL is built from the fixed values in ``functions.patterns`` so both sides
use one definition of every pattern and constant.
"""

from __future__ import annotations

from quillrank.functions import patterns as P
from quillrank.operators.labels import DEFAULT_FLAG, flag_code


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _unescape(x: str) -> str:
    for ent, ch in P.HTML_ENTITIES:
        x = f"replace({x}, {q(ent)}, {q(ch)})"
    return x


def sql_list(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


DOC_RECORDS = f"""
SELECT doc_id AS id, doc_id AS page_id, CAST(NULL AS BIGINT) AS revision_id,
       '/' || lang || '/' || CAST(doc_id AS VARCHAR) AS url,
       split_part(text, chr(10), 1) AS title,
       text AS content, CASE WHEN starts_with(text, '==') THEN '' ELSE split_part(text, chr(10) || chr(10) || '==', 1) END AS summary,
       CAST([] AS VARCHAR[]) AS links, CAST([] AS VARCHAR[]) AS images, CAST([] AS VARCHAR[]) AS refs
FROM documents"""

def _strip_tags(x: str) -> str:
    return f"regexp_replace({x}, {q(P.HTML_TAG)}, '', 'g')"


def _edge_trim(x: str) -> str:
    return f"regexp_replace({x}, {q(P.HTML_EDGE_WS)}, '', 'g')"


def unquoted(hrefs: str) -> str:
    """A list of attribute values without their quotes."""
    return f"list_transform({hrefs}, lambda h: regexp_replace(h, {q(P.HREF_QUOTES)}, '', 'g'))"


_TITLE = _edge_trim(_unescape(_strip_tags(f"regexp_extract(html, {q(P.HTML_TITLE)}, 1)")))
_CONTENT = _edge_trim(_unescape(_strip_tags("x")))

HTML_RECORDS = f"""
SELECT id, page_id, revision_id, url, title, content,
       CASE WHEN starts_with(content, '==') THEN '' ELSE split_part(content, chr(10) || chr(10) || '==', 1) END AS summary,
       links, images, refs
FROM (
  SELECT page_id AS id, TRY_CAST(regexp_extract(url, {q(P.URL_DOC_KEY)}, 1) AS BIGINT) AS page_id,
         page_id AS revision_id, url, {_TITLE} AS title,
         {_CONTENT} AS content,
         list_filter(hrefs, lambda h: starts_with(h, '/') AND NOT starts_with(h, '//')) AS links,
         list_filter(hrefs, lambda h: regexp_matches(h, '^https?://')) AS refs,
         {unquoted(f"regexp_extract_all(html, {q(P.HTML_IMG)}, 1)")} AS images
  FROM (
    SELECT *, regexp_replace(regexp_replace(regexp_replace(src, {q(P.HTML_DROP)}, '', 'g'),
                {q(P.HTML_HEADING)}, chr(10) || chr(10) || '== \\1 ==' || chr(10), 'g'),
                {q(P.HTML_BLOCK)}, chr(10), 'g') AS x
    FROM (
      SELECT page_id, url, html, {unquoted(f"regexp_extract_all(html, {q(P.HTML_HREF)}, 1)")} AS hrefs,
             CASE WHEN length(array_to_string(regexp_extract_all(html, {q(P.HTML_ARTICLE)}, 1), chr(10))) > 0
                  THEN array_to_string(regexp_extract_all(html, {q(P.HTML_ARTICLE)}, 1), chr(10))
                  WHEN regexp_matches(html, {q(P.HTML_BODY)}) THEN regexp_extract(html, {q(P.HTML_BODY)}, 1)
                  ELSE html END AS src
      FROM pages)))"""


def _body(c: str) -> str:
    pos = f"strpos({c}, {q(P.NOTES_MARKER)})"
    return f"left({c}, greatest(CASE WHEN {pos} - 2 >= 0 THEN {pos} - 2 ELSE length({c}) + {pos} - 2 END, 0))"


def _stripped(c: str) -> str:
    step = "left(acc, greatest(CASE WHEN strpos(acc, m) > 0 THEN strpos(acc, m) - 1 ELSE length(acc) - 1 END, 0))"
    return f"list_reduce({sql_list(P.BACK_MATTER_MARKERS)}, lambda acc, m: {step}, {c})"


def _median(lst: str) -> str:
    return (f"CASE WHEN len({lst}) > 0 THEN (CAST(list_sort({lst})[(len({lst}) - 1) // 2 + 1] AS DOUBLE) "
            f"+ CAST(list_sort({lst})[len({lst}) // 2 + 1] AS DOUBLE)) / 2.0 END")


def _nonws(c: str) -> str:
    return f"regexp_extract_all({c}, {q(P.NON_WS)})"


READ_FORMULAS = {
    "grade_level": "0.39::DOUBLE * (_W / _S) + 11.8::DOUBLE * (_Y / _W) - 15.59::DOUBLE",
    "reading_ease": "206.835::DOUBLE - 1.015::DOUBLE * (_W / _S) - 84.6::DOUBLE * (_Y / _W)",
    "ColemanLiauIndex": "5.88::DOUBLE * (_C / _W) - 29.6::DOUBLE * (_S / _W) - 15.8::DOUBLE",
    "GunningFogIndex": "0.4::DOUBLE * ((_W / _S) + 100.0::DOUBLE * (_P / _W))",
    "ARI": "4.71::DOUBLE * (_C / _W) + 0.5::DOUBLE * (_W / _S) - 21.43::DOUBLE",
    "SMOGIndex": "1.043::DOUBLE * sqrt(30.0::DOUBLE * (_P / _S)) + 3.1291::DOUBLE",
}

_SENT_LENGTHS = f"list_transform(string_split(_body, '.'), lambda p: len({_nonws('p')}))"
_WORD_LENGTHS = f"list_transform({_nonws('_body')}, lambda w: length(w))"

FEATURE_SQL = {
    "nSents": "CASE WHEN _no_text THEN 0 ELSE _dots + 1 END",
    "meanSentLength": f"CASE WHEN _no_text THEN 0.0::DOUBLE ELSE CAST(len(regexp_extract_all(_body, {q(P.SENT_PIECE_WORD)})) AS DOUBLE) / CAST(_dots + 1 AS DOUBLE) END",
    "medianSentLength": f"CASE WHEN _no_text THEN 0.0::DOUBLE ELSE {_median(_SENT_LENGTHS)} END",
    "nWords": f"CAST(len(list_filter({_nonws('_body')}, lambda w: NOT list_contains({sql_list(P.WORD_STOP_TOKENS)}, w))) AS BIGINT)",
    "meanWordLength": f"CASE WHEN _no_text THEN 0.0::DOUBLE ELSE CASE WHEN _nw > 0 THEN CAST(length(regexp_replace(_body, {q(P.WS_RUN)}, '', 'g')) AS DOUBLE) / CAST(_nw AS DOUBLE) END END",
    "medianWordLength": f"CASE WHEN _no_text THEN 0.0::DOUBLE ELSE {_median(_WORD_LENGTHS)} END",
    "nChars": "CASE WHEN _no_text THEN 0 ELSE length(replace(replace(_body, chr(10), ''), '=', '')) END",
    "nWordsSummary": f"CAST(len({_nonws('summary')}) AS BIGINT)",
    "nImages": "CAST(coalesce(len(images), 0) AS BIGINT)",
    "nLinks": "CAST(coalesce(len(links), 0) AS BIGINT)",
    "nRefs": "CAST(coalesce(len(refs), 0) AS BIGINT)",
    "nSections": "CAST(len(string_split(content, chr(10) || chr(10) || '==')) AS BIGINT)",
    "pageId": "page_id",
    "revisionId": "revision_id",
    "title": "title",
    "url": "url",
}
for _name, _f in READ_FORMULAS.items():
    FEATURE_SQL[_name] = f"CASE WHEN NOT _no_text AND _W > 0 THEN {_f} END"

MEASURES = ["meanWordLength", "meanSentLength", "nChars", "nImages", "nLinks", "nSections", "nSents", "nRefs",
            "nWordsSummary", "pageId", "revisionId", "title", "url", "reading_ease", "grade_level",
            "ColemanLiauIndex", "GunningFogIndex", "ARI", "SMOGIndex"]
TABLE_COLUMNS = MEASURES + ["flags", "flagged", "featured", "score"]


def features_ctes(records_sql: str, columns: list[str] | None = None, prefix: str = "") -> str:
    """CTE chain ending in ``{prefix}feat`` with id + the requested measures."""
    cols = columns or MEASURES
    sel = ",\n       ".join(f"{FEATURE_SQL[c]} AS {c}" for c in cols)
    return f"""{prefix}rec AS ({records_sql}),
{prefix}f1 AS (SELECT *, {_body('content')} AS _body, {_stripped('content')} AS _stripped FROM {prefix}rec),
{prefix}f2 AS (SELECT *, (coalesce(length(content), 0) < 5 OR coalesce(length(_stripped), 0) <= 5) AS _no_text,
               regexp_extract_all(lower(_stripped), {q(P.READ_WORD)}) AS _toks,
               len({_nonws('_body')}) AS _nw,
               length(_body) - length(replace(_body, '.', '')) AS _dots FROM {prefix}f1),
{prefix}f3 AS (SELECT *, list_transform(_toks, lambda w: greatest(1, len(regexp_extract_all(w, {q(P.READ_VOWEL_GROUP)}))
                 - CASE WHEN regexp_matches(w, {q(P.READ_SILENT_E)}) THEN 1 ELSE 0 END)) AS _syl FROM {prefix}f2),
{prefix}f4 AS (SELECT *, CAST(len(_toks) AS DOUBLE) AS _W,
               CAST(greatest(1, len(regexp_extract_all(_stripped, {q(P.READ_SENT_END)}))) AS DOUBLE) AS _S,
               CAST(coalesce(list_sum(_syl), 0) AS DOUBLE) AS _Y,
               CAST(len(list_filter(_syl, lambda s: s >= 3)) AS DOUBLE) AS _P,
               CAST(length(array_to_string(_toks, '')) AS DOUBLE) AS _C FROM {prefix}f3),
{prefix}feat AS (SELECT id, {sel} FROM {prefix}f4)"""


LABEL_ROWS = f"""SELECT doc_id AS label_id, CAST(CASE WHEN quality = 0 THEN {flag_code(DEFAULT_FLAG)} END AS INTEGER) AS flags,
       quality = 0 AS flagged0, coalesce(quality = 1, false) AS featured0,
       CASE WHEN quality = 0 THEN 0.0::DOUBLE END AS score FROM labels"""


def table_ctes(records_sql: str, prefix: str = "") -> str:
    """``{prefix}tbl``: features + labels, the stored feature table."""
    cols = ", ".join(f"f.{c}" for c in MEASURES)
    return f"""{features_ctes(records_sql, prefix=prefix)},
{prefix}labs AS ({LABEL_ROWS}),
{prefix}tbl AS (SELECT f.id, {cols}, l.flags, coalesce(l.flagged0, false) AS flagged,
                coalesce(l.featured0, false) AS featured, l.score
         FROM {prefix}feat f LEFT JOIN {prefix}labs l ON f.pageId = l.label_id)"""


def doc_table() -> str:
    return table_ctes(DOC_RECORDS)


def html_table() -> str:
    return table_ctes(HTML_RECORDS, prefix="h")
