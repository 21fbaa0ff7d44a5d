"""URL filter: explicit rules and a path-template tree (operator 2, DataFrame functions only).

Rules come first: a rule fits its host and all subdomains if the url's path starts with the rule's, the longest wins.
Other urls get the verdict of their template.  Digits become ``{n}`` at once; the distinct (host, path) shapes that are
left, with their counts and labels, form a tree per host, as deep as its longest path; chains without forks are passed in
one step, so the work follows the most forks of a path:

1. from the root down, a node with many children that are rarely seen again turns them into one wildcard;
2. from the leaves up, at every fork, branches of one parent that go on alike are compared: by a two-sided z test of
   their labelled share of bad pages against the common one they lie below, near or above it, and those of one side that
   don't differ from that side's common share either are merged into one (``*-``, ``*`` or ``*+``);
3. a template is rejected once its share of bad labels, shrunk towards its host's and the whole table's, reaches
   ``block_at``.

Pages meet partial aggregations only, then one equi-join with the verdicts by shape, which adaptive execution
broadcasts when it measures it small and otherwise splits where one shape is hot.  Every round is a table in the shared
folder that holds only the shapes that go on, and what is known of the nodes is a table beside it.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged as the shape of
the empty path; repeated rows are judged row by row; page_id may be null; null labels are ignored; a page labelled twice
counts twice; without labels the method allows everything; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Names of merged branches whose share lies below, near or above that of all branches beside them.
SIDES = ("*-", "*", "*+")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_path(url: Column) -> tuple[Column, Column]:
    """The lower-cased (A-Z) host and the path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule (verdict, host, path), else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _generalised(shapes: DataFrame, many: int, seldom: float) -> DataFrame:
    """Shapes with variable segments as wildcards in ``tree``, and in ``forks`` the places in it where the tree branches.

    A round takes every node down to its next fork at once, past segments that all its shapes share, and then one segment
    further; so the rounds follow the most forks on a path, not its length.  What a node needs to know of its shapes is a
    table of its own, so that a host that holds most shapes is split, or meets a broadcast.
    """
    keep = ["host", "shape", "n", "seen", "bad", "tree", "forks", "rest"]
    parts = F.split("shape", "/")  # the part before the first slash is empty
    live = shapes.select("host", "shape", "n", "seen", "bad", F.slice(parts, 1, 1).alias("tree"), F.lit([]).cast("array<int>").alias("forks"), F.slice(parts, F.lit(2), F.size(parts)).alias("rest"))
    live, done = C.materialize(live, "url-tree"), []
    while True:
        open_ = live.where("size(rest) > 0")
        done.append(live.where("size(rest) = 0"))
        if open_.isEmpty():
            break
        segment = open_.select("host", "tree", F.posexplode("rest").alias("place", "token")).groupBy("host", "tree", "place").agg((F.min("token") != F.max("token")).alias("fork"))
        fork = C.materialize(segment.where("fork").groupBy("host", "tree").agg(F.min("place").alias("fork")), "url-forks")
        shared = F.least(F.coalesce("fork", F.size("rest")), F.size("rest"))
        down = open_.join(fork, ["host", "tree"], "left").withColumn("shared", shared)
        down = down.select("host", "shape", "n", "seen", "bad", "forks", F.concat("tree", F.slice("rest", F.lit(1), F.col("shared"))).alias("tree"), F.slice("rest", F.col("shared") + 1, F.size("rest")).alias("rest"))
        child = down.where("size(rest) > 0").groupBy("host", "tree", F.col("rest")[0].alias("token")).agg(F.sum("n").alias("n"))
        loose = child.groupBy("host", "tree").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).where((F.col("kinds") >= many) & (F.col("n") < seldom * F.col("kinds"))).select("host", "tree", F.lit(True).alias("loose"))
        loose = C.materialize(loose, "url-loose")
        token = F.get("rest", F.lit(0))
        step = F.when(F.col("loose") & (token != ""), "*").otherwise(token)
        at_fork = F.size("rest") > 0
        out = down.join(loose, ["host", "tree"], "left").withColumns({"forks": F.when(at_fork, F.array_append("forks", F.size("tree"))).otherwise(F.col("forks")), "tree": F.when(at_fork, F.array_append("tree", step)).otherwise(F.col("tree")), "rest": F.slice("rest", F.lit(2), F.size("rest"))})
        live = C.materialize(out.select(keep), "url-tree")
    return reduce(DataFrame.union, [d.drop("rest") for d in done])


def _compared(branch: DataFrame, z: float) -> DataFrame:
    """Branches with the number of their group (``kinds``), and whether their share lies far below (-1) or above (1) its share."""
    group = ["host", "above", "below", "side"]
    pooled = branch.groupBy(*group).agg(F.sum("seen").alias("all_seen"), F.sum("bad").alias("all_bad"), F.count("*").alias("kinds"))
    rate = (F.col("all_bad") + 1) / (F.col("all_seen") + 2)
    off = F.col("bad") - F.col("seen") * rate
    far = (F.abs(off) > z * F.sqrt(F.col("seen") * rate * (1 - rate))) & (F.col("seen") >= 5)
    return branch.join(pooled, group).select(*group, "token", "seen", "bad", "kinds", F.when(far, F.signum(off)).otherwise(0).cast("int").alias("far"))


def _merged(tree: DataFrame, z: float) -> DataFrame:
    """(host, tree, template): branches of one parent with the same rest that don't differ share a wildcard.

    Forks are taken from the last one of each path to the first; a node's branches are compared when all below them are.
    """
    named = C.materialize(tree.groupBy("host", "tree", "forks").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad")).withColumn("template", F.col("tree")), "url-branches")
    for k in range(named.agg(F.max(F.size("forks"))).first()[0] or 0, 0, -1):
        deep = named.where(F.size("forks") >= k)
        d = F.get("forks", F.lit(k - 1))
        parts = [F.slice("template", F.lit(1), d).alias("above"), F.get("template", d).alias("token"), F.slice("template", d + 2, F.size("template")).alias("below")]
        branch = deep.select("host", *parts, "seen", "bad").groupBy("host", "above", "below", "token").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
        sided = _compared(branch.withColumn("side", F.lit(0)), z).withColumn("side", F.col("far")).drop("kinds", "far")
        alike = _compared(sided, z).where("kinds > 1 and far = 0").withColumn("mark", F.element_at(F.array(*map(F.lit, SIDES)), F.col("side") + 2))
        alike = C.materialize(alike.select(F.col("host").alias("h"), F.concat("above", F.array("token"), "below").alias("was"), F.size("above").alias("place"), F.concat("above", F.array("mark"), "below").alias("now")), "url-alike")
        same = (F.col("host") == F.col("h")) & (F.col("template") == F.col("was")) & (F.get("forks", F.lit(k - 1)) == F.col("place"))
        named = C.materialize(named.join(alike, same, "left").select("host", "tree", "forks", "seen", "bad", F.coalesce("now", "template").alias("template")), "url-branches")
    return named


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], labels: DataFrame, block_at: float = 0.8, strength: float = 10.0, z: float = 1.96, many: int = 20, seldom: float = 3.0) -> DataFrame:
    """page_id, host, path, rule, verdict, template for every row; ``labels``: (page_id, bad 0/1)."""
    mark = C.made()
    host, path = host_path(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("shape", F.regexp_replace("path", "[0-9]+", "{n}"))
    known = labels.select("page_id", F.col("bad").cast("double").alias("bad")).where("bad is not null")
    counted = base.groupBy("host", "shape").agg(F.count("*").alias("n"))
    marked = base.join(known, "page_id").groupBy("host", "shape").agg(F.count("*").alias("seen"), F.sum("bad").alias("bad"))
    shapes = counted.join(marked, ["host", "shape"], "left").na.fill(0, ["seen", "bad"])
    tree = _generalised(shapes, many, seldom)

    kept = _merged(tree, z)
    merged = kept.groupBy("host", "template").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
    by_host = merged.groupBy("host").agg(F.sum("seen").alias("host_seen"), F.sum("bad").alias("host_bad"))
    total = by_host.agg(F.sum("host_seen").alias("total_seen"), F.sum("host_bad").alias("total_bad"))  # one row
    prior = (F.col("total_bad") + 1) / (F.col("total_seen") + 2)
    host_rate = (F.col("host_bad") + strength * prior) / (F.col("host_seen") + strength)
    hosts = by_host.join(F.broadcast(total), F.lit(True)).select("host", host_rate.alias("host_rate"))
    share = (F.col("bad") + strength * F.col("host_rate")) / (F.col("seen") + strength)
    judged = merged.join(hosts, "host").select("host", "template", F.when(share >= block_at, "block").otherwise("allow").alias("by_template"))
    verdicts = tree.select("host", "shape", "tree").join(kept.select("host", "tree", "template"), ["host", "tree"]).join(judged, ["host", "template"]).select("host", "shape", "template", "by_template")

    rule, by_rule = rule_columns(rules)
    out = base.join(verdicts, ["host", "shape"], "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(by_rule, "by_template", F.lit("allow")).alias("verdict"), F.concat("host", F.array_join("template", "/")).alias("template"))
    C.release(mark, [out])
    return out
