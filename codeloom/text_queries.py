"""Queries of the scalar rules over texts, words and addresses of the ordinary tables; the SQL computes the same rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalar as s
from .functions import values as v
from .queries import query


def _in(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_FOLDERS = ["src", "lib", "tests", "docs", "node_modules", ".github", "a/b/__tests__", "python/pkg"]
_ENDINGS = [".py", ".ts", ".tsx", ".md", ".jsx", ".rs", "", ".test.js", "_test.py", "/__init__.py", "/README.md"]
_PATH = f"{_list(_FOLDERS)}[doc_id % 8 + 1] || '/' || CASE WHEN n_chars % 5 = 0 THEN 'test_' ELSE '' END || regexp_replace(split_part(text, ' ', 1), '[^A-Za-z0-9_]', '', 'g') || doc_id || {_list(_ENDINGS)}[n_chars % 11 + 1]"


@query(f"""WITH p AS (SELECT doc_id, {_PATH} AS path FROM documents), n AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, string_split(path, '/') AS parts FROM p), x AS (SELECT *, lower(regexp_extract(name, '^.+?(\\.[^.]+)$', 1)) AS suffix, lower(name) AS low, parts[:-2] AS folders FROM n),
m AS (SELECT *, replace(regexp_replace(regexp_replace(path, '\\.[^./]+$', ''), '(^|/)__init__$', ''), '/', '.') AS module, CASE WHEN suffix = '.py' THEN 'Python' WHEN suffix IN ('.js', '.jsx') THEN 'JavaScript' WHEN suffix IN ('.ts', '.tsx') THEN 'TypeScript' END AS language FROM x)
SELECT doc_id, path, module, regexp_replace(module, '^(src|lib|python|site-packages)\\.(.)', '\\2') AS layout_module, language, CASE WHEN suffix IN ('.tsx', '.jsx') THEN substr(suffix, 2) ELSE lower(language) END AS parse_language,
CASE WHEN low IN {_in([n.lower() for n in v.CONFIG_NAMES])} OR parts[1] = '.github' THEN 'CONFIG' WHEN low IN {_in([n.lower() for n in v.DOC_NAMES])} OR suffix IN {_in(v.DOC_EXTENSIONS)} AND len(parts) <= 2 THEN 'DOCUMENTATION'
  WHEN list_has_any([lower(q) FOR q IN parts], {_list(v.TEST_DIRECTORIES)}) OR regexp_matches(low, '^(test_|_test\\.|_spec\\.|\\.test\\.|\\.spec\\.)|(_test\\.(py|js|ts|tsx|jsx)|\\.(test|spec)\\.(js|ts|tsx|jsx)|\\.(test|spec)\\.)$') THEN 'TEST' WHEN suffix IN {_in(v.SOURCE_EXTENSIONS)} THEN 'SOURCE' ELSE 'UNKNOWN' END AS category,
regexp_matches(name, '^test_.*\\.py$|_test\\.py$|^test_.*\\.(js|ts|tsx|jsx)$|\\.test\\.(js|ts|tsx|jsx)$') OR list_has_any(folders, ['tests', 'test', '__tests__']) AND (starts_with(name, 'test_') OR ends_with(name, '_test.py')) AS test_file,
list_has_any(folders, {_list(v.IGNORED_DIRECTORIES)}) OR name IN {_in(v.IGNORED_FILES)} AS ignored FROM m""".replace("parts[:-2]", "parts[1:len(parts) - 1]"))
def document_paths(t):
    """A path made of each document's columns, and what the path rules make of it."""
    pick = lambda names, key: F.get(F.array(*[F.lit(n) for n in names]), (key % len(names)).cast("int"))
    word = F.regexp_replace(F.split("text", " ")[0], "[^A-Za-z0-9_]", "")
    path = F.concat(pick(_FOLDERS, F.col("doc_id")), F.lit("/"), F.when(F.col("n_chars") % 5 == 0, "test_").otherwise(""), word, F.col("doc_id").cast("string"), pick(_ENDINGS, F.col("n_chars")))
    rows, p = t("documents").select("doc_id", path.alias("path")), F.col("path")
    language = s.language_of(p)
    return rows.select("doc_id", "path", s.module_of_path(p).alias("module"), s.layout_module(s.module_of_path(p)).alias("layout_module"), language.alias("language"), s.parse_language(language, p).alias("parse_language"), s.file_category(p).alias("category"), s.is_test_file(p).alias("test_file"), s.is_ignored(p).alias("ignored"))


@query("""WITH u AS (SELECT page_id, regexp_replace(url, '^https?://[^/]+', CASE WHEN page_id % 7 = 0 THEN 'http://github.com' WHEN page_id % 7 = 1 THEN 'https://www.github.com' WHEN page_id % 7 = 2 THEN 'https://github.org' ELSE 'https://github.com' END) AS url FROM pages),
h AS (SELECT *, regexp_matches(url, '^https://(www\\.)?github\\.com/+[A-Za-z0-9][A-Za-z0-9._-]*/+[A-Za-z0-9][A-Za-z0-9._-]*/*$') AS hit FROM u)
SELECT page_id, CASE WHEN hit THEN split_part(url, '/', 4) END AS owner, CASE WHEN hit THEN regexp_replace(split_part(url, '/', 5), '\\.git$', '') END AS name FROM h""")
def page_repositories(t):
    """Every page's address moved to a host of repositories: is it one?"""
    at = F.col("page_id") % 7
    host = F.when(at == 0, "http://github.com").when(at == 1, "https://www.github.com").when(at == 2, "https://github.org").otherwise("https://github.com")
    moved = F.concat(host, F.regexp_replace("url", "^https?://[^/]+", ""))
    return t("pages").select("page_id", s.repository_of(moved).alias("r")).select("page_id", "r.owner", "r.name")


_WORDS = "SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents"


@query(f"""SELECT word, regexp_matches(word, '{v.REVISION}') AND NOT contains(word, '..') AND length(word) <= 128 AS valid, regexp_matches(word, '{v.SECRET_KEY}') AS secret,
CASE WHEN contains(word, '{{') THEN regexp_replace(regexp_replace(word, '\\{{.*? => (.*?)\\}}', '\\1', 'g'), '//', '/', 'g') ELSE regexp_replace(word, '^.* => ', '') END AS numstat_path,
CASE upper(substr(word, 1, 1)) WHEN 'A' THEN 'ADDED' WHEN 'D' THEN 'DELETED' WHEN 'R' THEN 'RENAMED' WHEN 'C' THEN 'COPIED' ELSE 'MODIFIED' END AS status FROM ({_WORDS})""")
def word_rules(t):
    """Every word of the documents as a revision, a key, a path and a status code."""
    words = t("documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    w = F.col("word")
    return words.select("word", s.revision_is_valid(w).alias("valid"), s.is_secret_key(w).alias("secret"), s.numstat_path(w).alias("numstat_path"), s.diff_status(w).alias("status"))


@query(f"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS rows FROM documents)
SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 80) AS cleaned, array_to_string(rows[2:3], chr(10)) AS lines_2_3, CASE WHEN length(text) = 0 THEN 0 ELSE len(rows) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END::INT AS line_count,
md5(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '{v.SECRET_ASSIGNMENT.replace(chr(39), chr(39) * 2)}', '\\1=REDACTED', 'g')) AS redacted,
md5(regexp_replace(text, '(?i)({"|".join(v.LOG_KEYS)})\\s*[:=]\\s*(["'']?[^"''\\s,;}}]+["'']?)', '\\1=REDACTED', 'g')) AS log_line, nullif(regexp_extract(text, '(?s)\\{{.*\\}}'), '') AS json FROM l""")
def document_pieces(t):
    """Pieces of every document: its first characters in one line, its second and third line, its lines, and both redactions."""
    x = F.col("text")
    return t("documents").select("doc_id", s.clean_line(x, 80).alias("cleaned"), s.snippet(x, F.lit(2), F.lit(3)).alias("lines_2_3"), s.line_count(x).alias("line_count"), F.md5(s.redact_text(x)).alias("redacted"), F.md5(s.redact_log_line(x)).alias("log_line"), s.json_in(x).alias("json"))
