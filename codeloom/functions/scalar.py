"""Scalar functions over paths, names, texts and revisions: Column in, Column out, no Python on the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as v
from .folding import casefold


def _map(known: dict, key: Column, default) -> Column:
    pairs = [F.lit(x) for kv in known.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default)) if default is not None else F.try_element_at(F.create_map(*pairs), key)


def parts_of(path: Column) -> Column:
    return F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))


def name_of(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def suffix_of(path: Column) -> Column:
    """The last extension with its dot, in lower case; empty for dot files and names without one."""
    return F.lower(F.regexp_extract(name_of(path), r"^.+?(\.[^.]+)$|^$", 1))


def module_of_path(path: Column) -> Column:
    """``a/b.py`` -> ``a.b``, ``a/__init__.py`` -> ``a``."""
    bare = F.regexp_replace(F.array_join(parts_of(path), "/"), r"\.[^./]+$", "")
    return F.translate(F.regexp_replace(bare, r"(^|/)__init__$", ""), "/", ".")


def layout_module(module: Column) -> Column:
    """The module without a leading source folder, where more remains."""
    return F.regexp_replace(module, r"^(src|lib|python|site-packages)\.(?=.)", "")


def normal_path(path: Column) -> Column:
    """The path with ``.`` and ``..`` worked off; ``..`` stops at the root."""
    step = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def language_of(path: Column) -> Column:
    return _map(v.LANGUAGES, suffix_of(path), None)


def parse_language(language: Column, path: Column) -> Column:
    """jsx and tsx refine their language; null where nothing can be parsed."""
    suffix = suffix_of(path)
    return F.when(suffix == ".tsx", "tsx").when(suffix == ".jsx", "jsx").when(language.isin("Python", "JavaScript", "TypeScript"), F.lower(language))


def is_ignored(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(v.IGNORED_DIRECTORIES)) | F.element_at(parts, -1).isin(v.IGNORED_FILES)


def is_contained(path: Column) -> Column:
    """A relative path that stays below its root."""
    return path.isNotNull() & (path != "") & ~path.startswith("/") & ~path.rlike(r"[\x00:\\]") & ~F.exists(F.split(path, "/"), lambda p: p == "..")


def line_count(text: Column) -> Column:
    """Lines of a text; a final line feed ends its line."""
    return F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(text, "\n")) - text.endswith("\n").cast("int"))


def file_category(path: Column) -> Column:
    """CONFIG, DOCUMENTATION, TEST, SOURCE or UNKNOWN; the first rule that fits."""
    name, parts = F.lower(name_of(path)), F.transform(parts_of(path), F.lower)
    config = name.isin([n.lower() for n in v.CONFIG_NAMES]) | F.coalesce(F.get(parts, F.lit(0)) == ".github", F.lit(False))
    doc = name.isin([n.lower() for n in v.DOC_NAMES]) | (suffix_of(path).isin(v.DOC_EXTENSIONS) & (F.size(parts) <= 2))
    test = F.exists(parts, lambda p: p.isin(v.TEST_DIRECTORIES))
    test = reduce(lambda a, b: a | b, [name.startswith(p) for p in v.TEST_PREFIXES], test)
    test = reduce(lambda a, b: a | b, [name.endswith(s) for s in [*v.TEST_SUFFIXES, ".test.", ".spec."]], test)
    return F.when(config, "CONFIG").when(doc, "DOCUMENTATION").when(test, "TEST").when(suffix_of(path).isin(v.SOURCE_EXTENSIONS), "SOURCE").otherwise("UNKNOWN")


def is_test_file(path: Column) -> Column:
    """The narrower rule of the TESTS resolver."""
    name, parts = name_of(path), F.split(F.translate(path, "\\", "/"), "/")
    by_name = name.rlike(r"^test_.*\.py$|_test\.py$|^test_.*\.(js|ts|tsx|jsx)$|\.test\.(js|ts|tsx|jsx)$")
    inside = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin("tests", "test", "__tests__"))
    return by_name | (inside & (name.startswith("test_") | name.endswith("_test.py")))


def repository_of(url: Column) -> Column:
    """struct(owner, name) of a valid public repository url, else null."""
    value = F.trim(url)
    safe = r"[A-Za-z0-9][A-Za-z0-9._-]*"
    hit = value.rlike(rf"^https://(www\.)?github\.com/+{safe}/+{safe}/*$")
    owner = F.regexp_extract(value, r"^https://[^/]+/+([^/]+)/+[^/]+/*$", 1)
    name = F.regexp_replace(F.regexp_extract(value, r"^https://[^/]+/+[^/]+/+([^/]+)/*$", 1), r"\.git$", "")
    return F.when(hit & (name != "") & ~name.isin(".", "..") & name.rlike(rf"^{safe}$"), F.struct(owner.alias("owner"), name.alias("name")))


def revision_is_valid(revision: Column) -> Column:
    return revision.rlike(v.REVISION) & ~revision.contains("..") & (F.length(revision) <= 128)


def numstat_path(path: Column) -> Column:
    """``a/{x => y}/z`` -> ``a/y/z`` and ``x => y`` -> ``y``."""
    braces = F.regexp_replace(F.regexp_replace(path, r"\{.*? => (.*?)\}", "$1"), "//", "/")
    return F.when(path.contains("{"), braces).otherwise(F.regexp_replace(path, r"^.* => ", ""))


def diff_status(code: Column) -> Column:
    return _map({"A": "ADDED", "D": "DELETED", "M": "MODIFIED", "R": "RENAMED", "C": "COPIED", "T": "MODIFIED"}, F.upper(F.substring(code, 1, 1)), "MODIFIED")


def change_type(file_added: Column, file_deleted: Column) -> Column:
    return F.when((file_added > 0) & (file_deleted == 0), "ADDED").when((file_deleted > 0) & (file_added == 0), "DELETED").otherwise("MODIFIED")


def edge_priority(kind: Column) -> Column:
    return _map(v.EDGE_PRIORITY, kind, 100)


def item_priority(item_type: Column, via: Column, all_direct: Column) -> Column:
    caller = F.when(all_direct & via.isin(v.BEHAVIOUR), "REQUIRED").otherwise("RECOMMENDED")
    required = item_type.isin("CHANGED_CODE", "AFFECTED_TEST", "CONFIGURATION_CHANGE")
    return F.when(required, "REQUIRED").when(item_type == "AFFECTED_CALLER", caller).when(item_type == "DOCUMENTATION_CHANGE", "INFORMATIONAL").otherwise("RECOMMENDED")


def item_sort(item_type: Column, priority: Column, index: Column) -> Column:
    return _map(v.PRIORITY_ORDER, priority, 2) * 1000 + _map(v.ITEM_ORDER, item_type, 8) * 100 + index


def redact_secret(text: Column) -> Column:
    return F.regexp_replace(text, v.SECRET_ASSIGNMENT, "$1=REDACTED")


def redact_text(text: Column) -> Column:
    return F.coalesce(redact_secret(F.regexp_replace(text, v.CONTROL_CHARACTERS, "")), F.lit(""))


def redact_log_line(text: Column) -> Column:
    return F.regexp_replace(text, rf"""(?i)({"|".join(v.LOG_KEYS)})\s*[:=]\s*(["']?[^"'\s,;}}]+["']?)""", "$1=REDACTED")


def is_secret_key(key: Column) -> Column:
    return F.coalesce(key, F.lit("")).rlike(v.SECRET_KEY)


def digest(**columns: Column) -> Column:
    """SHA-256 of the JSON of the columns, with sorted names."""
    return F.sha2(F.to_json(F.struct(*[columns[n].alias(n) for n in sorted(columns)])), 256)


def snippet(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` (from 1, clamped)."""
    lines = F.split(text, "\n")
    first = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(lines, first, F.greatest(F.least(end, F.size(lines)) - first + 1, F.lit(0))), "\n")


def clean_line(text: Column, limit: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit)


def json_in(text: Column) -> Column:
    """The text from the first { to the last }, or null."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def share(part: Column, whole: Column) -> Column:
    """Percent, one decimal."""
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), 1)


def display_name(qualified: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(qualified, F.lit("")), name)


def file_score(path: Column, query: str) -> Column:
    """6 the path, 5 a folder of it, 4 its end, 2 inside it, else 0; case counts."""
    return F.when(path == query, 6).when(path.startswith(query + "/"), 5).when(path.endswith(query), 4).when(path.contains(query), 2).otherwise(0)


def symbol_score(name: Column, qualified: Column, query: str) -> Column:
    """struct(score, stanza): 6 qualified name, 5 name, 4 end of the qualified name, 3 start or any case, 2 start in any case, 1 inside."""
    real = qualified.isNotNull() & (qualified != "") & (qualified != name)
    low, q = casefold(name), query.casefold()
    score = F.when(real & (qualified == query), 6).when(real & (qualified == F.concat(name, F.lit("." + query))), 5).when(name == query, 5)
    score = score.when((qualified != "") & qualified.endswith(query), 4).when(name.startswith(query), 3).when(low == q, 3).when(low.startswith(q), 2).when(low.contains(q), 1).otherwise(0)
    insensitive = (low == q) & ~name.startswith(query) & ~F.coalesce(qualified.endswith(query), F.lit(False))
    return F.struct(score.alias("score"), F.when(insensitive, "ci-exact").otherwise("").alias("stanza"))


def kind_rank(kind: Column) -> Column:
    return _map(v.KIND_RANK, F.upper(kind), 2)
