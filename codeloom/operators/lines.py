"""Texts as lines, identifiers, call sites and diff hunks, by built-in functions only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions import values as v

PY_NAME, JS_NAME = r"[A-Za-z_][A-Za-z0-9_]*", r"[A-Za-z_$][A-Za-z0-9_$]*"


def lines(files: DataFrame, text: str = "content") -> DataFrame:
    """One row a line: line_number from 1 and line; the text itself is dropped."""
    rest = [c for c in files.columns if c != text]
    split = files.select(*rest, F.posexplode(F.split(text, "\r\n|\n|\r")).alias("_n", "line"))
    return split.select(*rest, (F.col("_n") + 1).alias("line_number"), "line")


def is_code(line: Column) -> Column:
    """Not blank and not a comment as a whole."""
    return ~F.trim(F.regexp_replace(line, r"^\s+|\s+$", "")).rlike(r"^$|^#|^//")


def identifiers(code: DataFrame, script: bool = False, shortest: int = 2) -> DataFrame:
    """One row an identifier of a line, in order."""
    name = JS_NAME if script else PY_NAME
    found = F.regexp_extract_all("line", F.lit(rf"(?<![A-Za-z0-9_{'$' if script else ''}])({name})"), 1)
    rest = [c for c in code.columns if c != "line"]
    return code.select(*rest, F.posexplode(found).alias("place", "name")).where(F.length("name") >= shortest)


def call_sites(code: DataFrame, script: bool = False) -> DataFrame:
    """kind (call, method), name and receiver of each call on lines of code. A match of ``a.b(`` is one method call and
    not also a call of ``b``; where a keyword takes part in it, what remains is a plain call."""
    name = JS_NAME if script else PY_NAME
    keywords = v.JS_CALL_KEYWORDS if script else v.PY_CALL_KEYWORDS
    builtins = v.JS_BUILTINS if script else v.PY_BUILTINS
    guard = r"(?<!function )(?<!class )" if script else r"(?<!def )(?<!class )"
    edge = rf"(?<![A-Za-z0-9_{'$' if script else ''}])"
    pattern = rf"{guard}{edge}(?:({name})\.)?({name})\s*\("
    pairs = F.arrays_zip(F.regexp_extract_all("line", F.lit(pattern), 1).alias("receiver"), F.regexp_extract_all("line", F.lit(pattern), 2).alias("name"))
    rest = [c for c in code.columns if c != "line"]
    hits = code.where(is_code(F.col("line"))).select(*rest, F.posexplode(pairs).alias("place", "hit")).select(*rest, "place", "hit.receiver", "hit.name")
    is_method = (F.col("receiver") != "") & ~F.col("receiver").isin(keywords) & ~F.col("name").isin(keywords)
    plain = ~F.col("name").isin([*keywords, *builtins])
    hits = hits.withColumn("kind", F.when(is_method, "method").when(plain, "call")).where("kind IS NOT NULL")
    return hits.withColumn("receiver", F.when(F.col("kind") == "method", F.col("receiver")))


@F.arrow_udf(ArrayType(LongType()))
def running(values: pa.Array) -> pa.Array:
    """The running sums of each array of numbers."""
    at = np.asarray(values.offsets) - values.offsets[0].as_py()
    sums = np.concatenate([[0], np.cumsum(np.asarray(values.flatten(), dtype=np.int64))])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(sums[1:] - np.repeat(sums[at[:-1]], np.diff(at)), pa.int64()))


def hunks(diffs: DataFrame, keys: list[str], text: str = "diff") -> DataFrame:
    """Numbered lines of unified diffs: header, hunk, place (in the diff), side (OLD, NEW, or null for context), old_line, new_line, text.

    File headers stand before the first ``@@``; within hunks every ``+`` and ``-`` counts. A diff is one row, so its lines are numbered
    where it stands and nothing is shuffled."""
    pieces = diffs.select(*keys, F.split(text, r"\n(?=@@ -\d)").alias("_p"))
    pieces = pieces.select(*keys, "_p", running(F.transform("_p", lambda p: F.size(F.split(p, "\n")))).alias("_ends"), F.get("_p", F.lit(0)).rlike(r"^@@ -\d").alias("_bare"))
    rows = pieces.select(*keys, "_bare", F.posexplode(F.arrays_zip("_p", "_ends")).alias("_at", "_x")).select(*keys, (F.col("_at") + F.col("_bare").cast("int")).cast("long").alias("hunk"), F.split("_x._p", "\n").alias("_l"), "_x._ends")
    number = lambda group, default: F.coalesce(F.expr(f"try_cast(regexp_extract(header, '^@@ -(\\\\d+)(?:,(\\\\d+))? \\\\+(\\\\d+)(?:,(\\\\d+))? @@', {group}) AS INT)"), F.lit(default))
    kept = lambda line, at: (at > 0) & ~line.startswith("\\") & (line != "")
    ones = lambda other: running(F.transform("_l", lambda line, at: (kept(line, at) & (F.substring(line, 1, 1) != other)).cast("int")))
    rows = rows.where("hunk > 0").select(*keys, "hunk", F.get("_l", F.lit(0)).alias("header"), (F.col("_ends") - F.size("_l")).cast("int").alias("_ahead"), "_l", ones("+").alias("_o"), ones("-").alias("_w"))
    rows = rows.withColumns({"old_start": number(1, 1), "old_count": number(2, 1), "new_start": number(3, 1), "new_count": number(4, 1)})
    body = rows.select(*[c for c in rows.columns if c not in ("_l", "_o", "_w")], F.posexplode(F.arrays_zip("_l", "_o", "_w")).alias("_n", "_x"))
    body = body.select("*", F.col("_x._l").alias("line"), F.col("_x._o").alias("_old"), F.col("_x._w").alias("_new"), (F.col("_ahead") + F.col("_n")).alias("n")).where(kept(F.col("line"), F.col("_n")))
    mark = F.substring("line", 1, 1)
    side = F.when(mark == "+", "NEW").when(mark == "-", "OLD")
    return body.select(
        *keys, "hunk", F.col("n").alias("place"), "header", "old_start", "old_count", "new_start", "new_count", side.alias("side"),
        F.when(mark != "+", F.col("old_start") + F.col("_old") - 1).alias("old_line"), F.when(mark != "-", F.col("new_start") + F.col("_new") - 1).alias("new_line"), F.expr("substring(line, 2)").alias("text"),
    )


def changed_lines(numbered: DataFrame) -> DataFrame:
    """Added and deleted lines: side, line_number, change_type."""
    rest = [c for c in numbered.columns if c not in ("old_line", "new_line", "side", "text", "place")]
    return numbered.where("side IS NOT NULL").select(*rest, "side", F.coalesce(F.when(F.col("side") == "NEW", F.col("new_line")), "old_line").alias("line_number"), F.when(F.col("side") == "NEW", "ADDED").otherwise("DELETED").alias("change_type"), "text")
