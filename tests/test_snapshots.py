"""Diffs of snapshots by content: line diffs that can be applied, renames and copies by similarity."""

import random

import pytest

from codeloom.operators import lines
from codeloom.plans import diff, linediff, similar

FILES = "path string, content string"


def edited(r, text):
    rows = text.split("\n")
    for _ in range(r.randint(0, 6)):
        at = r.randint(0, len(rows))
        kind = r.choice("adrm")
        if kind == "a":
            rows[at:at] = [r.choice(["x", "", "new", "}"]) for _ in range(r.randint(1, 3))]
        elif kind == "d":
            del rows[at : at + r.randint(1, 4)]
        elif kind == "r" and at < len(rows):
            rows[at] += "!"
        else:
            rows[at:at] = rows[: r.randint(0, 3)]
    return "\n".join(rows)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    old = [(f"f{k:03d}", "\n".join(r.choice(["a", "b", "}", "", f"line {r.randint(0, 30)}"]) for _ in range(r.randint(0, 40)))) for k in range(120)]
    new = [(p, edited(r, t)) for p, t in old]
    old += [("empty", ""), ("filled", ""), ("emptied", "a\nb"), ("same", "a\nb"), ("null", None), ("ends", "a\n"), ("swap", "a\nb\nc\nd"), ("gone", "x")]
    new += [("empty", ""), ("filled", "a\nb"), ("emptied", ""), ("same", "a\nb"), ("null", "q"), ("ends", "a"), ("swap", "c\nd\na\nb"), ("fresh", "x")]
    return old, new


def apply(old, rows):
    """Hunks applied one by one."""
    out, at = [], 0
    source = old.split("\n")
    for h in sorted(rows, key=lambda h: h["hunk"]):
        first = h["old_start"] - (1 if h["old_count"] else 0)
        out += source[at:first]
        at = first
        for line in h["content"].split("\n"):
            mark, text = line[:1], line[1:]
            if mark != "+":
                assert source[at] == text
                at += 1
            if mark != "-":
                out.append(text)
    return "\n".join(out + source[at:])


def test_hunks_turn_the_old_into_the_new(spark, texts):
    old, new = texts
    a, b = spark.createDataFrame(old, FILES), spark.createDataFrame(new, FILES)
    scripted = linediff.script(a, b).persist()
    hunks = linediff.unified(scripted).persist()
    by_path = {}
    for h in hunks.collect():
        by_path.setdefault(h["path"], []).append(h)
    after, both = dict(new), set(dict(new)) & set(dict(old))
    assert {p: apply(t or "", by_path.get(p, [])) for p, t in old if p in both} == {p: after[p] or "" for p in both}
    got = {r["path"]: r["content"] for r in linediff.applied(a, hunks).collect()}
    assert {p: got[p] for p in both} == {p: after[p] or "" for p in both}
    assert "same" not in by_path and "empty" not in by_path and "gone" not in by_path
    # the parser of unified diffs numbers the same lines
    parsed = lines.hunks(linediff.diff_texts(hunks), ["path"])
    changed = {(r["path"], r["side"], r["line_number"]) for r in lines.changed_lines(parsed).collect()}
    stated = {(r["path"], "OLD" if r["mark"] == "-" else "NEW", r["old_line"] if r["mark"] == "-" else r["new_line"]) for r in scripted.where("mark != ' '").collect()}
    assert changed == stated
    kept = scripted.where("mark = ' '").groupBy("path").count().collect()
    assert {r["path"]: r["count"] for r in kept}["swap"] == 2


def test_a_diff_takes_no_round_over_all_lines(spark):
    # gaps within gaps: the lines of each level stand once only within those of the one before
    nested = lambda k, end: [f"a{k}", "x", *nested(k - 1, end), "x", f"b{k}"] if k else [end]
    old, new = "\n".join(["p", *nested(12, "old"), "q"]), "\n".join(["r", *nested(12, "new"), "s"])
    a, b = spark.createDataFrame([("f", old), ("g", "x")], FILES), spark.createDataFrame([("f", new), ("h", "x")], FILES)
    spark.sparkContext.setJobGroup("linediff", "")
    scripted = linediff.script(a, b)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("linediff")
    spark.sparkContext.setJobGroup("", "")
    rows = scripted.orderBy("seq").collect()
    assert {r["path"] for r in rows} == {"f"} and "\n".join(r["line"] for r in rows if r["mark"] != "+") == old and "\n".join(r["line"] for r in rows if r["mark"] != "-") == new
    assert [r["line"] for r in rows if r["mark"] == "-"] == ["p", "old", "q"]


@pytest.mark.parametrize("context", [0, 1, 3])
def test_hunks_of_a_script_and_of_its_texts_are_the_same(spark, texts, context):
    a, b = (spark.createDataFrame(t, FILES) for t in texts)
    made = linediff.hunks(a, b, context)
    rows = made.collect()
    assert rows and sorted(rows) == sorted(linediff.unified(linediff.script(a, b), context).collect())
    after, by_path = dict(texts[1]), {}
    for h in rows:
        by_path.setdefault(h["path"], []).append(h)
    assert {p: apply(dict(texts[0])[p] or "", h) for p, h in by_path.items()} == {p: after[p] or "" for p in by_path}
    assert linediff.hunks(a, b, context)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # the two texts


def brute(left, right, least):
    def bag(t):
        out = {}
        for x in t.split("\n") if t else []:
            out[x] = out.get(x, 0) + 1
        return out

    a, b = {p: bag(t) for p, t in left}, {p: bag(t) for p, t in right}
    files = {}
    for side in (a, b):
        for bagged in side.values():
            for x in bagged:
                files[x] = files.get(x, 0) + 1
    weight = {x: 1_000_000 // n for x, n in files.items()}
    total = lambda g: sum(n * weight[x] for x, n in g.items())
    out = {}
    for p, g in a.items():
        for q, h in b.items():
            if g and h:
                score = 2000 * sum(min(n, h.get(x, 0)) * weight[x] for x, n in g.items()) // (total(g) + total(h))
                if score >= least:
                    out[p, q] = score
    return out


@pytest.mark.parametrize("least", [300, 500, 900])
def test_similar_files_and_matching(spark, texts, least):
    left, right = texts[0][:60], [(f"n{p}", t) for p, t in texts[1][:60]]
    pairs = similar.similar(spark.createDataFrame(left, FILES), spark.createDataFrame(right, FILES), least)
    got = {(r["left_path"], r["right_path"]): r["score"] for r in pairs.collect()}
    assert got == brute(left, right, least)
    free, want = (set(), set()), set()
    for (p, q), _ in sorted(got.items(), key=lambda x: (-x[1], x[0])):
        if p not in free[0] and q not in free[1]:
            want.add((p, q))
            free[0].add(p)
            free[1].add(q)
    assert {(r["left_path"], r["right_path"]) for r in similar.one_to_one(pairs).collect()} == want


def test_equal_files_make_one_pair(spark):
    body = "a\nb\nc"
    left = spark.createDataFrame([(f"l{k}", body) for k in range(50)] + [("x", "q")], FILES)
    right = spark.createDataFrame([(f"r{k}", body + "\nd") for k in range(50)], FILES)
    pairs, a, b = similar.similar_classes(left, right)
    assert [(r["left_path"], r["right_path"]) for r in pairs.collect()] == [("l0", "r0")]
    assert a.where("representative = 'l0'").count() == 50 and b.where("representative = 'r0'").count() == 50


def test_texts_are_not_joined_to_compare_them(spark, texts, monkeypatch):
    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return spark.createDataFrame(df.collect(), df.schema)

    monkeypatch.setattr(similar, "saved", cut)
    left, right = texts[0][:60], [(f"n{p}", t) for p, t in texts[1][:60]]
    left += [("f000b", left[0][1]), ("f001b", left[1][1]), ("none", None)]
    pairs, members, _ = similar.similar_classes(spark.createDataFrame(left, FILES), spark.createDataFrame(right, FILES), 500)
    plans.append(pairs._jdf.queryExecution().optimizedPlan().toString())
    assert plans and not [p for p in plans if "Join" in p and "content" in p]
    first = lambda side: {t or "": min(p for p, u in side if (u or "") == (t or "")) for _, t in side}
    assert {(r["left_path"], r["right_path"]): r["score"] for r in pairs.collect()} == brute([(p, t) for t, p in first(left).items()], [(p, t) for t, p in first(right).items()], 500)
    assert {r["path"]: r["representative"] for r in members.collect()} == {p: first(left)[t or ""] for p, t in left}


def test_renames_and_copies(spark):
    body = "\n".join(f"line {k}" for k in range(20))
    other = "\n".join(f"other {k}" for k in range(20))
    base = [("a.py", body), ("keep.py", other), ("equal.py", "e1\ne2"), ("lost.py", "q")]
    head = [("b.py", body + "\nmore"), ("keep.py", other), ("copy.py", other.replace("other 3", "?")), ("moved.py", "e1\ne2"), ("new.py", "z")]
    a, b = spark.createDataFrame(base, FILES), spark.createDataFrame(head, FILES)
    rows = {r["path"]: (r["status"], r["old_path"]) for r in similar.renames(diff.snapshot_diff(a, b), a, b).collect()}
    assert rows == {"b.py": ("RENAMED", "a.py"), "copy.py": ("COPIED", "keep.py"), "moved.py": ("RENAMED", "equal.py"), "lost.py": ("DELETED", None), "new.py": ("ADDED", None)}
