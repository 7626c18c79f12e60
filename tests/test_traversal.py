"""Traversal: what is found first, and how many rows are compared for it."""

from codeloom.operators import traversal

EDGES = "source string, target string, kind string"


def brute(roots, edges, max_depth):
    """node -> depth, rank, root, via, via_source, path of kinds."""
    seen = {r: (0, k, r, None, None, ()) for k, r in enumerate(roots, 1)}
    level = list(roots)
    for depth in range(1, max_depth + 1):
        found = {}
        for source, target, kind in edges:
            if source in level and target not in seen:
                by = (seen[source][1], kind)
                if target not in found or by < found[target][0]:
                    found[target] = (by, source, kind)
        level = sorted(found, key=lambda n: (found[n][0], n))
        ahead = len(seen)
        for k, n in enumerate(level, 1):
            _, source, kind = found[n]
            seen[n] = (depth, ahead + k, seen[source][2], kind, source, (*seen[source][5], kind))
    return seen


def test_only_the_least_parent_of_a_node_is_compared(spark, monkeypatch):
    edges = [(f"r{k:02d}", f"n{m}", kind) for k in range(30) for m in range(5) for kind in ("b", "a")]
    edges += [(f"n{m}", f"t{k}", "c") for m in range(5) for k in range(3)] + [("t0", "r00", "d"), ("r03", "r03", "d"), ("n1", "n0", "a")]
    edges += edges[:40]  # repeated ones
    roots = [f"r{k:02d}" for k in range(30)]
    compared, first_wins = [], traversal.first_wins

    def counted(df, keys, order):
        compared.append(df.count())
        return first_wins(df, keys, order)

    monkeypatch.setattr(traversal, "first_wins", counted)
    got = traversal.bounded_bfs(spark.createDataFrame([(r, f"{k:03d}") for k, r in enumerate(roots)], "node string, rank string"), spark.createDataFrame(edges, EDGES), 3)
    rows = {r["node"]: (r["depth"], r["rank"], r["root"], r["via"], r["via_source"], tuple(s["kind"] for s in r["path"])) for r in got.collect()}
    assert rows == brute(roots, edges, 3)
    assert compared == [30, 20, 3, 0]  # of 340 edges into five nodes 20 come from the least parent, twice each kind
    assert got.where("node = 't2'").head()["path"][1].asDict() == {"source": "n0", "kind": "c", "target": "t2"}


def test_large_levels_are_joined_by_shuffle(spark, monkeypatch):
    edges = [(f"r{k % 7}", f"n{k % 11}", f"k{k % 3}") for k in range(200)] + [(f"n{k % 11}", f"t{k}", "a") for k in range(60)] + [("r1", None, "z")]
    args = [spark.createDataFrame([(f"r{k}", k) for k in range(7)], "node string, rank int"), spark.createDataFrame(edges, EDGES), 2]
    small = sorted(map(repr, traversal.bounded_bfs(*args).collect()))
    monkeypatch.setattr(traversal, "SMALL", 2)
    monkeypatch.setattr(traversal, "SENT", 2, raising=False)
    assert sorted(map(repr, traversal.bounded_bfs(*args).collect())) == small
    assert sum("node=None" in r for r in small) == 1  # an end that is not known is a node, without a way on
