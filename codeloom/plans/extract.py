"""Symbols, imports and exports of Python and ECMAScript files, one parse a file on the executors; files that fail don't stop the
others."""

from __future__ import annotations

import ast
import platform
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as s
from . import script

SYMBOL = T.StructType([T.StructField(n, t) for n, t in [("name", T.StringType()), ("qualified_name", T.StringType()), ("kind", T.StringType()), ("line_start", T.IntegerType()), ("line_end", T.IntegerType()), ("start_column", T.IntegerType()), ("end_column", T.IntegerType()), ("signature", T.StringType()), ("parent_index", T.IntegerType()), ("bases", T.ArrayType(T.StringType())), ("implements", T.ArrayType(T.StringType())), ("exported", T.BooleanType())]])
IMPORT = T.StructType([T.StructField(n, t) for n, t in [("source", T.StringType()), ("imported_name", T.StringType()), ("alias", T.StringType()), ("kind", T.StringType()), ("start_line", T.IntegerType()), ("end_line", T.IntegerType())]])
EXPORT = T.StructType([T.StructField(n, t) for n, t in [("name", T.StringType()), ("kind", T.StringType()), ("start_line", T.IntegerType()), ("end_line", T.IntegerType())]])
SCHEMA = T.StructType([T.StructField("file_id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("symbols", T.ArrayType(SYMBOL)), T.StructField("imports", T.ArrayType(IMPORT)), T.StructField("exports", T.ArrayType(EXPORT))])


_MARKER = re.compile(r"(<{7}|={7}|>{7}|\|{7})( |$)")
_TEXTS = re.compile(r"""#[^\n]*|\"{3}(?:\\.|[^\\])*?\"{3}|'{3}(?:\\.|[^\\])*?'{3}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.S)
_GOES_ON = re.compile(r"(else|elif|except|finally|case)\b|[)\]}]")


def _indent(row: str) -> int:
    row = row.expandtabs(8)
    return len(row) - len(row.lstrip())


def _parse(rows: list[str], lo: int, hi: int, more: str = "") -> list[ast.stmt]:
    """Statements of rows[lo:hi] at their own lines and columns, or SyntaxError."""
    deep = _indent(rows[lo]) > 0
    tree = ast.parse(("if 1:\n" if deep else "") + "\n".join(rows[lo:hi]) + more + "\n")
    ast.increment_lineno(tree, lo - deep)
    return tree.body[0].body + tree.body[1:] if deep else tree.body


def _header(rows: list[str], lo: int, hi: int) -> tuple[list[ast.stmt], int]:
    """The function or class whose header begins at ``lo``, without its body, and where the body begins."""
    for stop in range(lo + 1, min(hi, lo + 40) + 1):
        try:
            return _parse(rows, lo, stop, " pass"), stop
        except (SyntaxError, ValueError):
            continue
    row = rows[lo].rstrip(":( ")
    try:
        return _parse([*rows[:lo], row + (": pass" if row.lstrip().startswith("class") else "(): pass")], lo, lo + 1), lo + 1
    except (SyntaxError, ValueError):
        return [], lo + 1


def _quoted(rows: list[str]) -> set[int]:
    """The rows that begin inside a text in triple quotes."""
    out, source = set(), "\n".join(rows)
    for m in _TEXTS.finditer(source):
        if m[0][:3] in ('"""', "'''"):
            first = source.count("\n", 0, m.start())
            out.update(range(first + 1, first + m[0].count("\n") + 1))
    return out


def _block(rows: list[str], ends: list[int], lo: int) -> tuple[list[ast.stmt], int] | None:
    """The statements from ``lo`` on and how many blocks they take: more than one only where brackets go on at the margin."""
    for n, end in enumerate(ends[:200]):
        try:
            return _parse(rows, lo, end), n + 1
        except (SyntaxError, ValueError) as e:
            if "never closed" not in str(e):
                return None
    return None


def _recovered(rows: list[str], lo: int, hi: int, quoted: set[int]) -> list[ast.stmt]:
    """What parses of rows[lo:hi]: block by block by indentation, and inside the blocks that fail."""
    solid = [i for i in range(lo, hi) if i not in quoted and rows[i].strip() and not rows[i].lstrip().startswith("#")]
    if not solid:
        return []
    least, starts, decorated = _indent(rows[solid[0]]), [], False
    for i in solid:
        outer = _indent(rows[i]) <= least
        if not starts or (outer and not decorated and not _GOES_ON.match(rows[i].lstrip())):
            starts.append(i)
        decorated = rows[i].lstrip().startswith("@") if outer else decorated
    out, k = [], 0
    while k < len(starts):
        at, ends = starts[k], [*starts[k + 1 :], hi]
        whole = _block(rows, ends, at)
        if whole:
            out, k = out + whole[0], k + whole[1]
            continue
        made, body = _header(rows, at, ends[0])
        inner = _recovered(rows, body, ends[0], quoted)
        own = [x for x in made if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
        if own:
            last = max(i for i in range(at, ends[0]) if rows[i].strip())
            own[-1].body, own[-1].end_lineno, own[-1].end_col_offset = inner, last + 1, len(rows[last].encode())
        out, k = out + own + inner * (not own), k + 1
    return out


def _parameters(source: str, at: int) -> str:
    """The parameters of the function whose name ends before ``at``, with their brackets, as they are written."""
    first = source.find("(", at)
    if first < 0:
        return ""
    deep, k = 0, first
    while k < len(source):
        if m := _TEXTS.match(source, k):
            k = m.end()
            continue
        deep += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(source[k], 0)
        k += 1
        if not deep:
            return source[first:k]
    return ""


def _python(source: str, module: str = "") -> tuple[str, list[dict], list[dict]]:
    """Status, symbols (functions, classes, imported names), imports. After a syntax error all blocks that parse are used."""
    rows, status = source.split("\n"), "parsed"
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        status, tree = "syntax_error", ast.parse("")
        clean = ["" if _MARKER.match(r) else r.replace("\0", " ").rstrip("\r") for r in rows]
        tree.body = _recovered(clean, 0, len(clean), _quoted(clean))
    symbols: list[dict] = []
    imports: list[dict] = []
    raw = [r.encode() for r in rows]
    starts = [0]
    for r in rows:
        starts.append(starts[-1] + len(r) + 1)
    column = lambda line, byte: len(raw[line - 1][:byte].decode(errors="replace")) + 1

    def add(node: ast.AST, name: str, qualified: str, kind: str, parent: int | None, signature: str | None, bases: list[str] | None = None) -> int:
        own = {"name": name, "qualified_name": qualified, "kind": kind, "line_start": node.lineno, "line_end": node.end_lineno, "start_column": column(node.lineno, node.col_offset), "end_column": column(node.end_lineno, node.end_col_offset)}
        symbols.append(own | {"signature": signature, "parent_index": parent, "bases": bases or [], "implements": [], "exported": False})
        return len(symbols) - 1

    def visit(node: ast.AST, parent: int | None, prefix: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                is_class = isinstance(child, ast.ClassDef)
                kind = "CLASS" if is_class else "ASYNC_FUNCTION" if isinstance(child, ast.AsyncFunctionDef) else "FUNCTION"
                bases = [ast.unparse(b).split("[")[0] for b in child.bases] if is_class else []
                named = source.find(child.name, starts[child.lineno - 1] + column(child.lineno, child.col_offset) + 3)
                signature = None if is_class else child.name + _parameters(source, named + len(child.name))
                at = add(child, child.name, prefix + child.name, kind, parent, signature, bases)
                visit(child, at, prefix + child.name + ".")
            elif isinstance(child, ast.Import):
                for a in child.names:
                    imports.append({"source": a.name, "imported_name": None, "alias": a.asname, "kind": "python_import", "start_line": child.lineno, "end_line": child.end_lineno})
                    bound = a.asname or a.name.split(".")[0]
                    add(child, bound, bound, "IMPORT", None, None)
            elif isinstance(child, ast.ImportFrom):
                for a in child.names:
                    imports.append({"source": "." * child.level + (child.module or ""), "imported_name": a.name, "alias": a.asname, "kind": "python_from_import", "start_line": child.lineno, "end_line": child.end_lineno})
                    if a.name != "*":
                        add(child, a.asname or a.name, a.asname or a.name, "IMPORT", None, None)
            else:
                visit(child, parent, prefix)

    visit(tree, None, f"{module}." if module else "")
    return status, symbols, imports


#: Parsers by language, with what each is.
PARSERS = {"python": f"ast {platform.python_version()}", **dict.fromkeys(("javascript", "jsx", "typescript", "tsx"), "token scanner 1")}


def parser_versions(parsed_files: DataFrame) -> DataFrame:
    """``parsed_files`` with the version of the parser of each file's ``parse_language``; null where there is none."""
    known = F.create_map(*[F.lit(x) for kv in PARSERS.items() for x in kv])
    return parsed_files.withColumn("parser_version", F.try_element_at(known, F.col("parse_language")))


def read(source: str | None, language: str | None, module: str = "") -> tuple[str, list[dict], list[dict], list[dict]]:
    """Status, symbols, imports and exports of one file."""
    if source is None or language not in PARSERS:
        return "unsupported", [], [], []
    return (*_python(source, module), []) if language == "python" else script.read(source, language, module)


def parsed(files: DataFrame) -> DataFrame:
    """``files`` (file_id, path, language, content) -> file_id, status, symbols, imports, exports."""
    rows = files.select("file_id", s.parse_language(F.col("language"), F.col("path")).alias("language"), s.module_of_path(F.col("path")).alias("module"), "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                try:
                    got = read(row.content, row.language, row.module or "")
                except Exception:  # noqa: BLE001  one file must not fail the job
                    got = ("failed", [], [], [])
                out.append((row.file_id, *got))
            yield pd.DataFrame(out, columns=["file_id", "status", "symbols", "imports", "exports"])

    return rows.mapInPandas(parse, SCHEMA)


def symbols(parsed_files: DataFrame) -> DataFrame:
    """One row a symbol: symbol_id = file_id * 2^20 + place in the file, and its parent's."""
    rows = parsed_files.select("file_id", F.posexplode("symbols").alias("place", "s"))
    id_ = lambda place: F.col("file_id") * (1 << 20) + place
    return rows.select(id_(F.col("place")).alias("symbol_id"), "file_id", "s.*").withColumn("parent_symbol_id", id_(F.col("parent_index"))).drop("parent_index")


def imports(parsed_files: DataFrame) -> DataFrame:
    rows = parsed_files.select("file_id", F.posexplode("imports").alias("place", "i"))
    return rows.select((F.col("file_id") * (1 << 20) + F.col("place")).alias("import_id"), "file_id", "i.*")


def exports(parsed_files: DataFrame) -> DataFrame:
    rows = parsed_files.select("file_id", F.posexplode("exports").alias("place", "e"))
    return rows.select((F.col("file_id") * (1 << 20) + F.col("place")).alias("export_id"), "file_id", "e.*")


def status_counts(parsed_files: DataFrame) -> DataFrame:
    return parsed_files.groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum(F.size("symbols")).alias("symbols"), F.sum(F.size("imports")).alias("imports"), F.sum(F.size("exports")).alias("exports"))
