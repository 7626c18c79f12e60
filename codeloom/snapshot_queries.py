"""Queries of snapshots, indexes and logs over the ordinary tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import explanation
from .functions.folding import casefold
from .operators.lineage import new_folder, release
from .plans import linediff, search, similar
from .queries import ORACLES, query

_MOVED = "SELECT 'd' || doc_id AS path, text AS content FROM documents", "SELECT 'n' || doc_id AS path, text || chr(10) || 'moved to ' || doc_id AS content FROM documents"


@query(f"""WITH f AS (SELECT side, min(path) AS path, content FROM (SELECT 0 AS side, * FROM ({_MOVED[0]}) UNION ALL SELECT 1, * FROM ({_MOVED[1]})) GROUP BY side, content),
l AS (SELECT side, path, line, count(*) AS n FROM (SELECT side, path, unnest(string_split(content, chr(10))) AS line FROM f WHERE content != '') GROUP BY 1, 2, 3),
w AS (SELECT line, 1000000 // count(*) AS weight FROM l GROUP BY 1), t AS (SELECT side, path, sum(n * weight) AS total FROM l JOIN w USING (line) GROUP BY 1, 2),
o AS (SELECT a.path AS left_path, b.path AS right_path, sum(least(a.n, b.n) * weight) AS o FROM l a JOIN l b ON a.line = b.line JOIN w ON w.line = a.line WHERE a.side = 0 AND b.side = 1 GROUP BY 1, 2)
SELECT left_path, right_path, ((2000 * o) // (x.total + y.total))::BIGINT AS score FROM o JOIN t x ON x.side = 0 AND x.path = left_path JOIN t y ON y.side = 1 AND y.path = right_path WHERE (2000 * o) // (x.total + y.total) >= 500""")
def similar_texts(t):
    """Every document moved and added to: which are similar, and how much; equal documents by the first of them."""
    text, number = F.col("text"), F.col("doc_id").cast("string")
    old = t("documents").select(F.concat(F.lit("d"), number).alias("path"), text.alias("content"))
    new = t("documents").select(F.concat(F.lit("n"), number).alias("path"), F.concat(text, F.lit("\nmoved to "), number).alias("content"))
    return similar.similar_classes(old, new)[0]


@query("""WITH e AS (SELECT doc_id, text AS old, 'head' || chr(10) || replace(text, 'e.', 'E.') || chr(10) || 'tail' AS new FROM documents)
SELECT doc_id, md5(new) AS digest, (len(string_split(new, chr(10))) - len(string_split(old, chr(10))))::BIGINT AS growth FROM e""")
def line_diffs(t):
    """Every document edited: the hunks of the line diff, applied to the old text, give the new one."""
    edited = F.concat_ws("\n", F.lit("head"), F.replace("text", F.lit("e."), F.lit("E.")), F.lit("tail"))
    old, new = t("documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")), t("documents").select(F.col("doc_id").alias("path"), edited.alias("content"))
    hunks = linediff.saved(linediff.hunks(old, new))
    release(hunks.sparkSession)
    growth = hunks.groupBy("path").agg(F.sum(F.col("new_count") - F.col("old_count")).alias("growth"))
    return linediff.applied(old, hunks).join(growth, "path", "left").select(F.col("path").alias("doc_id"), F.md5("content").alias("digest"), F.coalesce("growth", F.lit(0)).cast("long").alias("growth"))


# --- searches by an index: the same rows as by a scan

@query(ORACLES["text_search"])
def indexed_text_search(t):
    files = t("documents").select(F.col("doc_id").alias("file_id"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.col("text").alias("content"), F.col("n_chars").alias("size_bytes"))
    folder = new_folder(files.sparkSession, "text-index")
    search.index_files(files, folder)
    return search.search_text_by(files.sparkSession, folder, "idiot", limit=100)


@query(ORACLES["ranked_symbol_search"].replace("%al%", "%l_%").replace("'al'", "'l_'").replace("'.al'", "'.l_'") + " -- the wildcard has no piece of three characters: a scan")
def scanned_symbol_search(t):
    return _symbols_by_index(t, "l_")


@query(ORACLES["ranked_symbol_search"].replace("%al%", "%rand#1_.%al%").replace("'al'", "'rand#1_.%al'").replace("'.al'", "'.rand#1_.%al'"))
def indexed_symbol_search(t):
    """Wildcards inside the query."""
    return _symbols_by_index(t, "rand#1_.%al")


def _symbols_by_index(t, text: str):
    part = t("part")
    symbols = part.select(F.col("p_partkey").alias("symbol_id"), F.col("p_partkey").alias("file_id"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), F.upper(F.split("p_type", " ")[0]).alias("kind"))
    folder = new_folder(part.sparkSession, "symbol-index")
    search.index_symbols(symbols, folder)
    return search.search_symbols_by(part.sparkSession, folder, part.select(F.col("p_partkey").alias("file_id"), F.col("p_brand").alias("path")), text, limit=50)


# --- replies and folded names

_REPLIES = """WITH b AS (SELECT doc_id, regexp_replace(substr(text, 1, 1200), '["\\\\{}\\x00-\\x1f]', ' ', 'g') AS body FROM documents),
r AS (SELECT doc_id, body, CASE doc_id % 9 WHEN 0 THEN '```json' || chr(10) || '{"summary": "' || body || '", "evidence_indices": [1, ' || doc_id || ', true, "x", 2.5, null], "suggested_checks": ["a  b", 7, "", "c", false, "d"], "uncertainty": " "}' || chr(10) || '```'
  WHEN 1 THEN 'Sure: {"summary": "ok ' || doc_id || '", "evidence_indices": [0]} done' WHEN 2 THEN '{"summary": "  ", "evidence_indices": [1]}' WHEN 3 THEN body WHEN 4 THEN '{"summary": "x", "evidence_indices": "1"}'
  WHEN 5 THEN '{"summary": 12, "evidence_indices": [false]}' WHEN 6 THEN '{"summary": "x" "y"}' WHEN 7 THEN '{"summary": "a", "evidence_indices": [3,2,1,0,9,8,7,6], "uncertainty": "' || body || '", "suggested_checks": "none"}'
  ELSE '{"summary": "' || doc_id || '", "evidence_indices": [' || doc_id || '], "suggested_checks": ["' || body || '"]}' END AS reply FROM b),
t AS (SELECT doc_id, body, reply, regexp_replace(regexp_replace(reply, '^```[a-zA-Z0-9_-]*\\s*', ''), '\\s*```$', '') AS text FROM r),
i AS (SELECT doc_id, body, CASE WHEN strpos(text, '{') > 0 AND strpos(reverse(text), '}') > 0 THEN substr(text, strpos(text, '{'), length(text) - strpos(text, '{') - strpos(reverse(text), '}') + 2) ELSE '' END AS js FROM t),
k AS (SELECT doc_id, js, CASE WHEN json_valid(js) THEN js END AS ok FROM i),
f AS (SELECT doc_id, js, ok, coalesce(trim(regexp_replace(ok ->> '$.summary', '\\s+', ' ', 'g')), '') AS summary, json_type(ok, '$.evidence_indices') AS kind, [x::BIGINT FOR x IN json_extract(ok, '$.evidence_indices[*]') IF json_type(x) IN ('UBIGINT', 'BIGINT')] AS whole,
  nullif(substr(trim(regexp_replace(coalesce(ok ->> '$.uncertainty', ''), '\\s+', ' ', 'g')), 1, 400), '') AS uncertainty,
  [substr(trim(regexp_replace(CASE x ->> '$' WHEN 'false' THEN 'False' WHEN 'true' THEN 'True' ELSE x ->> '$' END, '\\s+', ' ', 'g')), 1, 200) FOR x IN (CASE WHEN json_type(ok, '$.suggested_checks') = 'ARRAY' THEN json_extract(ok, '$.suggested_checks[*]') ELSE [] END)] AS checks FROM k),
e AS (SELECT *, CASE WHEN js = '' THEN 'reply contained no JSON object' WHEN ok IS NULL THEN 'reply was not valid JSON' WHEN summary = '' THEN 'reply had no summary' WHEN kind IS DISTINCT FROM 'ARRAY' THEN 'evidence_indices was not a list' WHEN len(whole) = 0 THEN 'evidence_indices was empty or invalid' END AS error FROM f)
SELECT doc_id, error, CASE WHEN error IS NULL THEN substr(summary, 1, 700) END AS summary, CASE WHEN error IS NULL THEN array_to_string(whole[1:6], ',') END AS evidence_indices, CASE WHEN error IS NULL THEN uncertainty END AS uncertainty,
CASE WHEN error IS NULL THEN array_to_string([c FOR c IN checks IF c != ''][1:4], '|') END AS suggested_checks FROM e"""


@query(_REPLIES)
def parsed_replies(t):
    """Replies around every document: fences, junk, missing parts and wrong types."""
    number, body = F.col("doc_id").cast("string"), F.regexp_replace(F.substring("text", 1, 1200), r'["\\{}\x00-\x1f]', " ")
    lit = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    replies = [
        lit('```json\n{"summary": "', body, '", "evidence_indices": [1, ', number, ', true, "x", 2.5, null], "suggested_checks": ["a  b", 7, "", "c", false, "d"], "uncertainty": " "}\n```'), lit('Sure: {"summary": "ok ', number, '", "evidence_indices": [0]} done'),
        lit('{"summary": "  ", "evidence_indices": [1]}'), body, lit('{"summary": "x", "evidence_indices": "1"}'), lit('{"summary": 12, "evidence_indices": [false]}'), lit('{"summary": "x" "y"}'),
        lit('{"summary": "a", "evidence_indices": [3,2,1,0,9,8,7,6], "uncertainty": "', body, '", "suggested_checks": "none"}'), lit('{"summary": "', number, '", "evidence_indices": [', number, '], "suggested_checks": ["', body, '"]}'),
    ]
    rows = t("documents").select("doc_id", F.get(F.array(*replies), (F.col("doc_id") % 9).cast("int")).alias("reply"))
    found = rows.select("doc_id", explanation.parsed(F.col("reply")).alias("e")).select("doc_id", "e.*")
    return found.withColumns({"evidence_indices": F.array_join(F.col("evidence_indices").cast("array<string>"), ","), "suggested_checks": F.array_join("suggested_checks", "|")})


@query("SELECT doc_id, md5(lower(replace(replace(replace(text, 'e', 'ß'), 'a', 'ΑΣ'), 'ß', 'ss'))) AS folded, contains(lower(replace(replace(text, 'a', 'ασ'), 'e', 'ss')), 'tss') AS hit FROM (SELECT doc_id, translate(lower(text), 'ßς', 'ss') AS text FROM documents)".replace("'ΑΣ'), 'ß', 'ss')", "'ασ'), 'ß', 'ss')"))
def folded_texts(t):
    """Texts with sharp s and capital sigma: folded, and searched by a query of another case."""
    plain = F.translate(F.lower("text"), "ßς", "ss")
    odd = F.replace(F.replace(plain, F.lit("e"), F.lit("ß")), F.lit("a"), F.lit("ΑΣ"))
    folded = t("documents").select("doc_id", casefold(odd).alias("f"))
    return folded.select("doc_id", F.md5("f").alias("folded"), F.col("f").contains("Tß".casefold()).alias("hit"))
