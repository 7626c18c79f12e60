"""ECMAScript extraction, and the graph of two repositories that must not mix."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions import scalar as s
from codeloom.plans import extract, resolve, script
from codeloom.sources import files as src

JS = """import Vue, { computed as calc } from "vue";
import * as geo from "geo";

export const PORT = process.env.PORT;
export default function Main(props) {
  return <p>it's fine</p>;
}
const tools = require("./tools.js");
export function sum(x, y) { return x + y; }
export async function load(url, opts = {}) {}
export class Panel {
  constructor(name) { this.name = name; }
  paint(ctx) { if (ctx) { return /[/"]x/.test(`a ${sum(1, 2)} b`); } }
  onTap = (e) => {};
  static async *walk() {}
}
const twice = (n) => n * 2, one = n => n;
var old = () => 1;
export { sum as s };
export { twice };
export * from "./more.js";
export default () => 1;
function* secret() { const inner = async () => { await load(); }; }
"""
TS = """import type { Route } from "web";

export interface Thing {
  id: string;
}

type Done = (err: Error | null) => void;

export enum Mode {
  OFF = "off",
}

export const makeRoute = <T,>(a: T, b?: number): Route => {
  return Route();
};

export default function setup(x: { a: number }): Route {
  return makeRoute();
}

class Real extends Base<T> implements Thing, Other {
  private id = "";
  get label(): string { return this.id; }
}
"""


def test_script_symbols():
    status, symbols, imports, exports = script.read(JS, "javascript", "m")
    assert status == "parsed"
    got = {x["qualified_name"]: x for x in symbols}
    kinds = {k: x["kind"] for k, x in got.items()}
    assert kinds == {
        "Vue": "IMPORT", "calc": "IMPORT", "geo": "IMPORT", "m.PORT": "VARIABLE", "m.Main": "FUNCTION", "m.sum": "FUNCTION", "m.load": "ASYNC_FUNCTION", "m.Panel": "CLASS",
        "m.Panel.constructor": "METHOD", "m.Panel.paint": "METHOD", "m.Panel.onTap": "ARROW_FUNCTION", "m.Panel.walk": "METHOD", "m.twice": "ARROW_FUNCTION", "m.one": "ARROW_FUNCTION",
        "m.secret": "FUNCTION", "m.secret.inner": "ARROW_FUNCTION",
    }
    assert {k for k, x in got.items() if x["exported"]} == {"m.PORT", "m.Main", "m.sum", "m.load", "m.Panel"}
    assert symbols[got["m.Panel.onTap"]["parent_index"]]["name"] == "Panel" and symbols[got["m.secret.inner"]["parent_index"]]["name"] == "secret"
    assert (got["m.load"]["signature"], got["m.twice"]["signature"], got["m.one"]["signature"], got["m.Panel.onTap"]["signature"]) == ("load(url, opts = {})", "twice(n)", "one = n =>", "onTap(e)")
    assert [got["m.sum"][c] for c in ("line_start", "start_column", "line_end", "end_column")] == [9, 8, 9, 44]
    assert [(i["source"], i["imported_name"], i["alias"], i["kind"]) for i in imports] == [("vue", None, "Vue", "es_module"), ("vue", "computed", "calc", "es_module"), ("geo", None, "geo", "es_module"), ("./tools.js", "tools", None, "commonjs")]
    assert [(e["name"], e["kind"]) for e in exports] == [("PORT", "named"), ("Main", "default"), ("sum", "named"), ("load", "named"), ("Panel", "named"), ("s", "named"), ("twice", "named"), ("*", "star"), ("default", "default")]


def test_typed_symbols():
    _, symbols, imports, exports = script.read(TS, "typescript", "web")
    got = {x["name"]: x for x in symbols}
    assert {k: x["kind"] for k, x in got.items()} == {"Route": "IMPORT", "Thing": "INTERFACE", "Done": "TYPE_ALIAS", "Mode": "ENUM", "makeRoute": "ARROW_FUNCTION", "setup": "FUNCTION", "Real": "CLASS", "label": "METHOD"}
    assert (got["Real"]["bases"], got["Real"]["implements"]) == (["Base"], ["Thing", "Other"]) and got["makeRoute"]["signature"] == "makeRoute(a: T, b?: number)"
    assert {(e["name"], e["kind"]) for e in exports} == {("Thing", "named"), ("Mode", "named"), ("makeRoute", "named"), ("setup", "default")}
    _, symbols, _, exports = script.read("export interface P { t: string; }\n\nconst Top: FC<P> = ({ t }) => <h1>{t}</h1>;\n\nexport default Top;\n", "tsx", "ui")
    assert {x["qualified_name"]: x["kind"] for x in symbols} == {"ui.P": "INTERFACE", "ui.Top": "ARROW_FUNCTION"} and ("default", "default") in {(e["name"], e["kind"]) for e in exports}


@pytest.mark.parametrize("source", ["function broken( {}\n", "const f = (a => {\n", "x = `${", "/* open", "class {", "import", "export", "export default", "const", "}", ")]", "a ? b : c => d"])
def test_broken_sources_are_read(source):
    status, symbols, _, _ = script.read(source, "javascript", "b")
    if source.startswith("function"):
        assert status == "syntax_error" and [x["name"] for x in symbols] == ["broken"]


TREE = {
    (1, "web/shapes.ts"): "export interface Shape { area(): number; }\nexport class Base {}\n",
    (1, "web/circle.ts"): 'import { Shape, Base } from "./shapes";\nimport paint from "../lib/paint";\n\nexport class Circle extends Base implements Shape {\n  area() {\n    return helper(paint);\n  }\n}\nfunction helper(x) { return x; }\n',
    (1, "lib/paint/index.js"): "export default function paint(x) { return x; }\n",
    (1, "lib/use.js"): 'const paint = require("./paint");\nimport far from "react";\nimport gone from "./gone";\nexport { paint };\nexport * from "./paint";\n',
    (1, "web/circle.test.ts"): 'import { Circle } from "./circle";\n\nit("works", () => { new Circle().area(); });\n',
    (1, "shop/cart.py"): "class Cart:\n    def total(self, items):\n        return add(items)\n\n\ndef add(items):\n    return sum(items)\n",
    (2, "shop/cart.py"): "class Cart:\n    pass\n",
    (2, "shop/order.py"): "from shop.cart import Cart\n\n\nclass Order(Cart):\n    pass\n",
    (2, "shop/other.py"): "class Own(Base):\n    pass\n",
}


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(r, p, t) for (r, p), t in TREE.items()]
    files = spark.createDataFrame(rows, "repository_id long, path string, content string").withColumn("language", s.language_of(F.col("path")))
    files = src.numbered(files)
    files = spark.createDataFrame(files.collect(), files.schema)
    parsed = spark.createDataFrame(extract.parsed(files).collect(), extract.SCHEMA)
    symbols = extract.symbols(parsed)
    edges = resolve.relationships(files, symbols, extract.imports(parsed), extract.exports(parsed)).collect()
    name = {r["symbol_id"]: r["name"] for r in symbols.collect()}
    path = {r["file_id"]: (r["repository_id"], r["path"]) for r in files.collect()}
    return {(e["type"], e["status"], name.get(e["source_symbol_id"]) or path[e["evidence_file_id"]], name.get(e["target_symbol_id"]) or path.get(e["target_file_id"])) for e in edges}, edges, files, parsed


def test_script_edges(graph):
    edges = graph[0]
    circle, use = (1, "web/circle.ts"), (1, "lib/use.js")
    assert {("EXTENDS", "RESOLVED", "Circle", "Base"), ("IMPLEMENTS", "RESOLVED", "Circle", "Shape")} <= edges
    assert {("IMPORTS", "RESOLVED", circle, "Shape"), ("IMPORTS", "RESOLVED", circle, "paint"), ("IMPORTS", "RESOLVED", use, "paint"), ("IMPORTS", "EXTERNAL", use, None), ("IMPORTS", "UNRESOLVED", use, None)} <= edges
    assert {("EXPORTS", "RESOLVED", circle, "Circle"), ("EXPORTS", "RESOLVED", (1, "lib/paint/index.js"), "paint"), ("EXPORTS", "RESOLVED", use, use)} <= edges
    assert ("CALLS", "RESOLVED", "area", "helper") in edges and ("REFERENCES", "RESOLVED", "area", "paint") in edges and ("REFERENCES", "RESOLVED", "area", "helper") in edges
    assert ("TESTS", "RESOLVED", (1, "web/circle.test.ts"), "Circle") in edges


def test_repositories_do_not_mix(graph):
    _, edges, files, _ = graph
    of = {r["file_id"]: r["repository_id"] for r in files.collect()}
    assert {e["repository_id"] for e in edges} == {1, 2}
    for e in edges:
        assert of[e["evidence_file_id"]] == e["repository_id"]
        for end in ("source_symbol_id", "target_symbol_id"):
            assert e[end] is None or of[e[end] >> 20] == e["repository_id"]
    assert ("EXTENDS", "RESOLVED", "Order", "Cart") in graph[0] and ("EXTENDS", "UNRESOLVED", "Own", None) in graph[0]


def test_rows_of_one_repository_go(spark, graph):
    _, edges, files, parsed = graph
    tables = {"files": files, "symbols": extract.symbols(parsed), "notes": spark.createDataFrame([(1, "x")], "note_id long, text string")}
    left = src.without_repository(tables, 1)
    assert {r["repository_id"] for r in left["files"].collect()} == {2} and left["notes"].count() == 1
    assert {r["file_id"] for r in left["symbols"].collect()} <= {r["file_id"] for r in left["files"].collect()}


def test_parser_versions(spark):
    df = spark.createDataFrame([("python",), ("tsx",), (None,)], "parse_language string")
    assert [r["parser_version"] is None for r in extract.parser_versions(df).collect()] == [False, False, True]
