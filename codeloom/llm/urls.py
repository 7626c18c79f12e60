"""URL filters by path templates, in DataFrame functions only.

A url is a host and a path. Rules (host, path prefix) decide where one fits; the longest wins. The rest is judged
by a tree of path templates per host, built level by level from the root until no path goes on. Segments that are numbers,
hexadecimal keys or dates become wildcards of their kind first. At each node:

* A segment stands apart if its share of bad labels differs from that of its siblings beyond chance (two-sided test at 5 % with
  a correction for small counts, so few labels need no threshold of their own).
* The other segments are compared as a whole: if their shares differ more than chance lets them (chi-square at 5 %), those of
  like shares (to a tenth) are merged; else all are. Segments without labels are merged with each other. Merged branches
  pool their subtrees, which are one node at the next level.
* In the template a merged segment becomes ``<*>`` where the node has at least ``CHILDREN`` children and it has less than
  ``RARE`` of its urls.

A branch's share of bad labels is smoothed by that of its parent, up to its host's and that of all; a branch with all the labels of
its parent keeps the parent's share, so depth alone adds nothing. A branch is rejected if its share reaches ``REJECT``.

Everything is aggregated by (host, typed path) before any join, so a host with a third of all urls costs one row a typed path;
counts of nodes are aggregates that are joined back once a level, no windows. What all paths of a branch begin with is passed over
in one round, so rounds are nested forks, not segments. A join has one row a key on the side of the tree, so the partition of a hot
key can be split on the other side, which adaptive execution does.

Cases: a null url, or one without ``://``, has an empty host and path and is judged by the labels of that branch;
repeated urls and ids count each; contradicting labels of an id go by their majority (ties are bad); null labels are no
labels; without any labels everything is allowed; very long and very deep urls are taken whole; no rows give no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

#: (verdict, rule)
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
CHILDREN, RARE = 8, 0.1
WEIGHT = 4.0  # labels that a prior counts as
REJECT = 0.5
CHANCE = 3.8416  # 1.96 squared
CHANCE_ABOVE = 1.645  # normal deviate of 5 % on one side, for chi-square by its cube root
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: kinds of variable segments; what they become
KINDS = [("^[0-9]+$", "<n>"), ("^[0-9]+[.][A-Za-z]+$", "<n.x>"), ("^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "<d>"), ("^[0-9a-fA-F-]{8,}$", "<h>")]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _CAPITALS, _SMALL)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _kind(segment: Column) -> Column:
    out = segment
    for pattern, kind in reversed(KINDS):
        out = F.when(segment.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def _kids(here: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The children of each node of ``here`` (host, branch, s, n, m, b, p): what they become in templates, where they go, the share
    there; and the saved table that this reads."""
    node = ["host", "branch"]
    kids = here.groupBy(*node, "s").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("b").alias("b"), F.max("p").alias("p"))
    nodes = kids.groupBy(*node).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n_all"), F.sum("m").alias("m_all"), F.sum("b").alias("b_all"))
    others = F.nullif(F.col("m_all") - F.col("m"), F.lit(0))
    both, spread = F.col("b_all") / F.nullif("m_all", F.lit(0)), 1 / F.nullif("m", F.lit(0)) + 1 / others
    gap = F.abs(F.col("b") / F.nullif("m", F.lit(0)) - (F.col("b_all") - F.col("b")) / others) - spread / 2
    apart = F.coalesce((gap > 0) & (gap * gap > F.lit(CHANCE) * both * (1 - both) * spread), F.lit(False))
    kids = kids.join(nodes, node).withColumn("apart", apart)
    alike = kids.where("NOT apart AND m > 0")
    level = alike.groupBy(*node).agg((F.sum("b") / F.sum("m")).alias("q"), (F.count(F.lit(1)) - 1).alias("df"))
    off = F.col("b") - F.col("m") * F.col("q")
    x2 = alike.join(level.where("df > 0 AND q > 0 AND q < 1"), node).groupBy(*node, "df").agg(F.sum(off * off / (F.col("m") * F.col("q") * (1 - F.col("q")))).alias("x2"))
    cube = 1 - 2 / (9 * F.col("df")) + F.lit(CHANCE_ABOVE) * F.sqrt(2 / (9 * F.col("df")))
    mixed = x2.where(F.col("x2") > F.col("df") * cube * cube * cube).select(*node, F.lit(True).alias("mixed"))
    tenth = F.floor((20 * F.col("b") + F.col("m")) / (2 * F.col("m"))).cast("string")
    to = F.when(F.col("apart"), F.concat(F.lit("="), "s")).when(F.col("mixed") & (F.col("m") > 0), F.concat(F.lit("+"), tenth)).otherwise("~")
    wild = ~F.col("apart") & (F.col("kinds") >= CHILDREN) & (F.col("n") < RARE * F.col("n_all"))
    told = store.saved(kids.join(mixed, node, "left").withColumns({"to": to, "t": F.when(wild, "<*>").otherwise(F.col("s"))}), "url-kids")
    pooled = told.groupBy(*node, "to").agg(F.sum("m").alias("m_to"), F.sum("b").alias("b_to"))
    share = F.when(F.col("m_to") == F.col("m_all"), F.col("p")).otherwise((F.col("b_to") + WEIGHT * F.col("p")) / (F.col("m_to") + WEIGHT))
    return told.join(pooled, [*node, "to"]).select(*node, "s", "t", "to", share.alias("p_to")), told


def branches(pages: DataFrame) -> DataFrame:
    """``pages`` (host, typed, bad or null) -> host, typed, bad_share, template: the smoothed share of each branch."""
    at = pages.groupBy("host", "typed").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("m"), F.sum(F.coalesce("bad", F.lit(0))).alias("b"))
    of_host = at.groupBy("host").agg(F.sum("m").alias("m"), F.sum("b").alias("b"))
    of_all = of_host.agg(((F.sum("b") + 1) / (F.sum("m") + 4)).alias("p_all"))
    share = of_host.crossJoin(F.broadcast(of_all)).select("host", ((F.col("b") + WEIGHT * F.col("p_all")) / (F.col("m") + WEIGHT)).alias("p"))  # one row
    # rest: the segments after the first slash that no level has taken yet
    rest = F.slice(F.split("typed", "/"), 2, F.greatest(F.size(F.split("typed", "/")) - 1, F.lit(0)))
    rounds = [store.saved(at.join(share, "host").withColumns({"rest": rest, "branch": F.lit(""), "template": F.lit("")}), "url-level")]
    while not (going := rounds[-1].where(F.size("rest") > 0)).isEmpty():
        ends = going.groupBy("host", "branch").agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
        unlike = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), F.lit(False))
        same = F.when(unlike > 0, unlike - 1).otherwise(F.least(F.size("low"), F.size("high"))).cast("int")
        shared = ends.select("host", "branch", same.alias("same"))
        went = going.join(shared, ["host", "branch"])
        # what all have in common is taken at once; paths that are no longer than it end there
        taken = F.when(F.col("same") > 0, F.concat_ws("/", "template", F.array_join(F.slice("rest", 1, F.col("same")), "/"))).otherwise(F.col("template"))
        left = F.slice("rest", F.col("same") + 1, F.greatest(F.size("rest") - F.col("same"), F.lit(0)))
        went = store.saved(went.withColumns({"template": taken, "rest": left}).drop("same"), "url-shared")
        here = went.where(F.size("rest") > 0).withColumn("s", F.get("rest", F.lit(0)))
        kids, told = _kids(here)
        moved = here.join(kids, ["host", "branch", "s"]).withColumns({"p": F.col("p_to"), "branch": F.concat_ws("/", "branch", "to"), "template": F.concat_ws("/", "template", "t"), "rest": F.expr("slice(rest, 2, size(rest))")})
        columns = rounds[-1].columns
        rounds.append(store.saved(moved.select(*columns).union(went.where(F.size("rest") == 0).select(*columns)), "url-level"))
        store.delete(went, told)
    every = pages.sparkSession.read.schema(rounds[0].schema).parquet(*[r.scratch_path for r in rounds])
    return every.where(F.size("rest") == 0).select("host", "typed", "template", F.col("p").alias("bad_share"))


def judged(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``pages`` (page_id, url), ``labels`` (page_id, bad) -> page_id, host, path, rule, verdict, template."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    typed = F.array_join(F.transform(F.split(path, "/"), _kind), "/")
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), typed.alias("typed"))
    known = labels.where("bad IS NOT NULL").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("b"))
    seen = parsed.join(known.withColumn("bad", F.when(F.col("b") * 2 >= F.col("n"), 1).otherwise(0)).select("page_id", "bad"), "page_id", "left")
    tree = branches(seen.select("host", "typed", "bad"))
    out = parsed.join(tree, ["host", "typed"], "left").withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("bad_share") >= REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), method).alias("verdict"), "template")


_KIND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{k}'" for p, k in KINDS) + " ELSE s END"
_RULE_SQL = "CASE " + " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{{}}'" for _, r in sorted(RULES, key=lambda r: -len(r[1]))) + " END"

_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[1]))
#: The query in DuckDB SQL.
ORACLE = f"""
WITH RECURSIVE parsed AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_CAPITALS}', '{_SMALL}') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
typed AS (SELECT *, array_to_string([{_KIND_SQL} FOR s IN string_split(path, '/')], '/') AS typed FROM parsed),
known AS (SELECT doc_id AS page_id, CASE WHEN sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) * 2 >= count(*) THEN 1 ELSE 0 END AS bad
          FROM labels WHERE quality IS NOT NULL GROUP BY 1),
groups AS (SELECT host, typed, count(*) AS n, count(bad) AS m, sum(coalesce(bad, 0)) AS b FROM typed LEFT JOIN known USING (page_id) GROUP BY 1, 2),
of_host AS (SELECT host, sum(m) AS m, sum(b) AS b FROM groups GROUP BY 1),
of_all AS (SELECT (sum(b) + 1) / (sum(m) + 4) AS p_all FROM of_host),
levels AS (
  SELECT g.host, typed, n, g.m, g.b, string_split(typed, '/')[2:] AS rest, (h.b + {WEIGHT} * p_all) / (h.m + {WEIGHT}) AS p, '' AS branch, '' AS template
  FROM groups g JOIN of_host h ON g.host = h.host CROSS JOIN of_all
  UNION ALL (
  WITH here AS (SELECT *, rest[1] AS s FROM levels WHERE len(rest) > 0),
  kids AS (SELECT host, branch, s, sum(n) AS n, sum(m) AS m, sum(b) AS b, max(p) AS p FROM here GROUP BY 1, 2, 3),
  nodes AS (SELECT host, branch, count(*) AS kinds, sum(n) AS n_all, sum(m) AS m_all, sum(b) AS b_all FROM kids GROUP BY 1, 2),
  gaps AS (SELECT k.*, kinds, n_all, m_all, b_all / nullif(m_all, 0) AS both_, 1 / nullif(m, 0) + 1 / nullif(m_all - m, 0) AS spread,
    abs(b / nullif(m, 0) - (b_all - b) / nullif(m_all - m, 0)) - (1 / nullif(m, 0) + 1 / nullif(m_all - m, 0)) / 2 AS gap
    FROM kids k JOIN nodes o ON k.host = o.host AND k.branch = o.branch),
  judged AS (SELECT *, coalesce(gap > 0 AND gap * gap > {CHANCE} * both_ * (1 - both_) * spread, FALSE) AS apart FROM gaps),
  alike AS (SELECT host, branch, sum(b) / sum(m) AS q, count(*) - 1 AS df FROM judged WHERE NOT apart AND m > 0 GROUP BY 1, 2),
  mixed AS (SELECT j.host, j.branch FROM judged j JOIN alike a ON j.host = a.host AND j.branch = a.branch WHERE NOT apart AND m > 0 AND df > 0 AND q > 0 AND q < 1
    GROUP BY j.host, j.branch, df HAVING sum((b - m * q) * (b - m * q) / (m * q * (1 - q))) > df * (1 - 2 / (9 * df) + {CHANCE_ABOVE} * sqrt(2 / (9 * df))) ** 3),
  told AS (SELECT j.*, CASE WHEN apart THEN '=' || s WHEN x.host IS NOT NULL AND m > 0 THEN '+' || CAST((20 * b + m) // (2 * m) AS VARCHAR) ELSE '~' END AS dest,
    CASE WHEN NOT apart AND kinds >= {CHILDREN} AND n < {RARE} * n_all THEN '<*>' ELSE s END AS t FROM judged j LEFT JOIN mixed x ON j.host = x.host AND j.branch = x.branch),
  pool AS (SELECT host, branch, dest, sum(m) AS m_to, sum(b) AS b_to FROM told GROUP BY 1, 2, 3)
  SELECT h.host, h.typed, h.n, h.m, h.b, h.rest[2:], CASE WHEN m_to = m_all THEN h.p ELSE (b_to + {WEIGHT} * h.p) / (m_to + {WEIGHT}) END, h.branch || '/' || c.dest, h.template || '/' || c.t
  FROM here h JOIN told c ON h.host = c.host AND h.branch = c.branch AND h.s = c.s JOIN pool q ON q.host = c.host AND q.branch = c.branch AND q.dest = c.dest)),
tree AS (SELECT host, typed, template, p AS bad_share FROM levels WHERE len(rest) = 0)
SELECT page_id, host, path, {_RULE_SQL.format(*[r for _, r in _BY_LENGTH])} AS rule,
       coalesce({_RULE_SQL.format(*[v for v, _ in _BY_LENGTH])}, CASE WHEN bad_share >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template
FROM typed LEFT JOIN tree USING (host, typed)
"""
