"""Reverse dependencies, change impact, blast radius, pull-request drafts and hubs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths, rules
from ..session import cut, discard

_CANDIDATES = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js", "/index.tsx"]


def dependency_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(target, dependent): the first candidate path of a relative import that is a file."""
    base = paths.resolve(F.concat(paths.dirname(F.col("file_path")), F.lit("/"), F.col("source")))
    tails = F.array(*[F.lit(t) for t in _CANDIDATES])
    c = (
        imports.filter(F.col("source").startswith("."))
        .select(F.col("file_path").alias("dependent"), "source", base.alias("base"))
        .distinct()
        .select("dependent", "source", "base", F.posexplode(tails).alias("pos", "tail"))
        .withColumn("path", F.concat("base", "tail"))
    )
    known = files.select(F.col("file_path").alias("path")).distinct()
    hit = c.join(known, "path").groupBy("dependent", "source").agg(F.min_by("path", "pos").alias("target"))
    return hit.select("target", "dependent").distinct()


def file_edges(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """(target, dependent) files from call edges between functions of different files."""
    from .code import node_id

    where = functions.select(node_id(F.col("name"), F.col("file_path")).alias("id"), "file_path").distinct()
    s, t = where.toDF("source", "dependent"), where.toDF("target", "file")
    return edges.join(s, "source").join(t, "target").filter("dependent <> file").select(F.col("file").alias("target"), "dependent").distinct()


def reach(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(seed, node, depth): everything that depends on a seed at a distance of up to ``most``, all
    seeds at once.

    ``edges``(target, dependent) are written once, as every step reads them. A step holds each end of
    the walks of its length once, and every such end is in the result or the seed itself; the least
    length counts, so that nothing found is looked up again in between.
    """
    e = cut(edges.select("target", "dependent").filter("target <> dependent").distinct())
    front = e.join(seeds.select(F.col("seed").alias("target")).distinct(), "target", "left_semi").select(F.col("target").alias("seed"), F.col("dependent").alias("node"))
    seen = front.withColumn("depth", F.lit(1))
    for depth in range(2, most + 1):
        step = front.join(e, front["node"] == e["target"]).select("seed", F.col("dependent").alias("node")).filter("seed <> node")
        # the last step is only read once, and the least depth makes it distinct
        front = cut(step.distinct()) if depth < most else step
        seen = seen.unionByName(front.withColumn("depth", F.lit(depth)))
    return seen.groupBy("seed", "node").agg(F.min("depth").alias("depth"))


def reach_counts(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, total): how many nodes depend on each seed, at any distance.

    Sets of seeds travel as bits, 64 to a word: a row (node, block, word) says which seeds of the
    block reach the node, so a round costs at most nodes x seeds / 64 rows, and only bits that are
    new go on to the next one. Seeds are numbered within hash blocks, without a global order.
    """
    n_seeds = seeds.select("seed").distinct().count()
    part = F.pmod(F.xxhash64("seed"), F.lit(max(1, n_seeds // 4096)))
    rank = Window.partitionBy("part").orderBy("seed")
    numbered = seeds.select("seed").distinct().withColumn("part", part).withColumn("n", F.row_number().over(rank) - 1)
    numbered = cut(numbered.select("seed", F.concat_ws("-", "part", (F.col("n") / 64).cast("int")).alias("block"), (F.col("n") % 64).alias("bit")))
    front = cut(numbered.groupBy(F.col("seed").alias("node"), "block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("word")))
    seen = front
    e = edges.select(F.col("target").alias("node"), "dependent").filter("node <> dependent").distinct()
    while not front.isEmpty():
        step = front.join(e, "node").groupBy(F.col("dependent").alias("node"), "block").agg(F.bit_or("word").alias("word"))
        old = seen.withColumnRenamed("word", "old")
        both = cut(step.join(old, ["node", "block"], "full").withColumn("new", F.coalesce("word", F.lit(0)).bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0))))))
        used = {id(x): x for x in (front, seen)}
        front = both.filter("new <> 0").select("node", "block", F.col("new").alias("word"))
        seen = both.select("node", "block", F.coalesce("old", F.lit(0)).bitwiseOR(F.coalesce("new", F.lit(0))).alias("word"))
        front._ql_path = seen._ql_path = both._ql_path
        discard(*used.values())
    per = seen.groupBy("block").agg(F.array(*[F.sum(F.expr(f"shiftrightunsigned(word, {i}) & 1L")) for i in range(64)]).alias("counts"))
    return numbered.join(per, "block").select("seed", (F.get("counts", F.col("bit")) - 1).cast("long").alias("total"))


def change_impact(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, direct, indirect, total, risk) over all transitive dependents."""
    edges = edges.filter("target <> dependent")
    near = edges.select(F.col("target").alias("seed"), "dependent").distinct().groupBy("seed").agg(F.count(F.lit(1)).alias("direct"))
    out = reach_counts(edges, seeds).join(near, "seed", "left").na.fill(0, ["direct"])
    return out.select("seed", "direct", (F.col("total") - F.col("direct")).alias("indirect"), "total", rules.change_risk(F.col("total")).alias("risk"))


def _callers(calls: DataFrame) -> DataFrame:
    """(callee, name, file_path): who calls a name, and from which file."""
    # the caller's id is its name, an @ and its file: names and paths may have that sign themselves
    c = calls.filter("caller is not null").select("callee", F.expr("substring(caller, 1, length(caller) - length(file_path) - 1)").alias("name"), "file_path")
    return c.distinct()


def blast_distances(functions: DataFrame, calls: DataFrame, seeds: DataFrame, most: int = 3) -> DataFrame:
    """(seed, name, depth): as ``blast_radius`` has them, without files and paths."""
    known = _callers(calls).join(functions.select("name", "file_path"), ["name", "file_path"], "left_semi")
    e = known.select(F.col("callee").alias("target"), F.col("name").alias("dependent"))
    return reach(e, seeds, most).withColumnRenamed("node", "name")


def blast_radius(functions: DataFrame, calls: DataFrame, seeds: DataFrame, most: int = 3) -> DataFrame:
    """(seed, name, file_path, depth, call_path): callers by name up to ``most`` steps away.
    Of several ways to a name the first counts: that of the earliest-found neighbour, and
    there the first calling function in file order."""
    order = functions.groupBy("name", "file_path").agg(F.min("fn_ord").alias("fn_ord"))
    c = cut(_callers(calls).join(order, ["name", "file_path"]))  # every step reads them
    front = cut(seeds.select("seed", F.col("seed").alias("name"), F.array("seed").alias("call_path"), F.lit("").alias("file_path"), F.lit(0).alias("depth"), F.lit("").alias("place")).distinct())
    seen = front
    for depth in range(1, most + 1):
        f = front.select("seed", F.col("name").alias("callee"), F.col("call_path").alias("way"), F.col("place").alias("before"))
        step = f.join(c, "callee").join(seen.select("seed", "name"), ["seed", "name"], "left_anti")
        first = Window.partitionBy("seed", "name").orderBy("before", "file_path", "fn_ord")
        step = step.withColumn("n", F.row_number().over(first)).filter("n = 1")
        place = F.concat("before", F.lit("/"), F.col("file_path"), F.lit("#"), F.lpad(F.col("fn_ord").cast("string"), 12, "0"))
        found = step.select("seed", "name", F.concat("way", F.array("name")).alias("call_path"), "file_path", F.lit(depth).alias("depth"), place.alias("place"))
        front = cut(found) if depth < most else found
        seen = seen.unionByName(front)
    return seen.filter("depth > 0").drop("place")


def blast_summary(affected: DataFrame, seeds: DataFrame) -> DataFrame:
    g = affected.groupBy("seed").agg(F.count(F.lit(1)).alias("functions"), F.count_distinct("file_path").alias("files"))
    out = seeds.select("seed").distinct().join(g, "seed", "left").na.fill(0, ["functions", "files"])
    return out.withColumn("risk", rules.blast_risk(F.col("functions"), F.col("files")))


def pr_summary(nodes: DataFrame, edges: DataFrame, names: DataFrame, risky: int = 5, most: int = 3, listed: bool = True) -> DataFrame:
    """(name, file_path, affected, affected_names, found, is_risky) for changed names; the last
    node of a name counts, dependents are nodes up to ``most`` calls away. Where they are only
    counted, ``listed`` is false and affected_names is empty."""
    last = nodes.groupBy("name").agg(F.max_by(F.struct("id", "file_path"), F.struct("file_path", "fn_ord")).alias("n"))
    asked = cut(names.select("name").distinct().join(last, "name", "left").select("name", F.col("n.id").alias("seed"), F.col("n.file_path").alias("file_path")))
    rev = edges.select("target", F.col("source").alias("dependent"))
    r = reach(rev, asked.filter("seed is not null").select("seed"), most)
    affected = F.count(F.lit(1)).alias("affected")
    if listed:
        by_id = nodes.groupBy(F.col("id").alias("node")).agg(F.max("name").alias("other"))
        g = r.join(by_id, "node", "left").groupBy("seed").agg(affected, F.array_sort(F.collect_list("other")).alias("affected_names"))
    else:
        g = r.groupBy("seed").agg(affected, F.lit(None).cast("array<string>").alias("affected_names"))
    out = asked.join(g, "seed", "left")
    return out.select(
        "name", "file_path", F.coalesce("affected", F.lit(0)).alias("affected"), F.coalesce("affected_names", F.array().cast("array<string>")).alias("affected_names"),
        F.col("seed").isNotNull().alias("found"), (F.coalesce("affected", F.lit(0)) > risky).alias("is_risky"),
    )


def pr_markdown(summary: DataFrame, shown: int = 5, by: list[str] | None = None) -> DataFrame:
    """One row with the draft of a pull request's description; with ``by`` one for each of its values."""
    tick = F.lit("`")
    note = F.when(F.col("is_risky"), " ⚠️ many callers depend on it").otherwise("")
    count = F.concat(F.col("affected").cast("string"), F.when(F.col("affected") == 1, " function").otherwise(" functions"))
    listed = F.array_join(F.transform(F.slice("affected_names", 1, shown), lambda n: F.concat(tick, n, tick)), ", ")
    more = F.size("affected_names") - shown
    extra = F.when(F.size("affected_names") > 0, F.concat(F.lit("\n  - Affects: "), listed, F.when(more > 0, F.concat(F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise(""))).otherwise("")
    line = F.when(~F.col("found"), F.concat(F.lit("- `"), F.col("name"), F.lit("` - not in the analyzed call graph (new, or outside of it)."))).otherwise(
        F.concat(F.lit("- `"), F.col("name"), F.lit("` ("), F.col("file_path"), F.lit(") - called by "), count, note, extra)
    )
    keys = [f"by_{k}" for k in by or []]
    rows = summary.select(*[F.col(k).alias(f"by_{k}") for k in by or []], F.struct("name", line.alias("line")).alias("l"), "is_risky")
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("l")).alias("ls"), F.bool_or("is_risky").alias("risky"))
    tail = F.when(F.coalesce("risky", F.lit(False)), "**Reviewer note:** many callers depend on some of these functions; check the places that call them.").otherwise(
        "**Reviewer note:** few callers depend on these changes."
    )
    body = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    return g.select(*[F.col(f"by_{k}").alias(k) for k in by or []], F.concat(F.lit("## What this PR changes\n\n"), body, F.lit("\n\n"), tail).alias("markdown"), F.coalesce("risky", F.lit(False)).alias("any_risky"))


def connections(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, connections): call edges that start or end in a file, both ends counted."""
    where = nodes.select("id", "file_path").distinct()
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    return ends.join(where, "id").groupBy("file_path").agg(F.count(F.lit(1)).alias("connections"))


def onboarding_stops(files: DataFrame, nodes: DataFrame, edges: DataFrame, entries: DataFrame, hubs: int = 6) -> DataFrame:
    """Where to start reading: files with entry points, then the most connected other core files."""
    links = connections(nodes, edges)
    why = files.select("file_path", F.col("language").alias("lang"), "explanation")
    first = Window.partitionBy("file_path").orderBy("start_line", "name")
    e = entries.withColumn("n", F.row_number().over(first)).filter("n = 1").join(links, "file_path", "left").join(why, "file_path", "left")
    e = e.select("file_path", "language", F.lit("entry-point").alias("reason"), F.col("description").alias("detail"), F.coalesce("explanation", F.concat(F.lit("Entry point: "), "name")).alias("explanation"), F.coalesce("connections", F.lit(0)).alias("connections"))
    rest = links.join(entries.select("file_path").distinct(), "file_path", "left_anti").filter(~paths.is_non_core_file(F.col("file_path")))
    top = rest.orderBy(F.desc("connections"), "file_path").limit(hubs).join(why, "file_path")
    plural = F.when(F.col("connections") == 1, " call-graph link.").otherwise(" call-graph links.")
    h = top.select("file_path", F.col("lang").alias("language"), F.lit("hub").alias("reason"), F.concat(F.lit("Highly connected: part of "), F.col("connections").cast("string"), plural).alias("detail"), "explanation", "connections")
    return e.unionByName(h)


def edge_coverage(nodes: DataFrame, edges: DataFrame, stops: DataFrame) -> DataFrame:
    """One row (edges, touching, percentage): call edges with an end in a stop."""
    where = nodes.select("id", "file_path").distinct()
    inside = where.join(stops.select("file_path").distinct(), "file_path", "left_semi").select("id", F.lit(1).alias("hit"))
    s, t = inside.toDF("source", "s"), inside.toDF("target", "t")
    x = edges.join(s, "source", "left").join(t, "target", "left")
    g = x.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("s").isNotNull() | F.col("t").isNotNull()).alias("touching"))
    pct = F.coalesce(F.try_divide(F.col("touching").cast("double"), F.col("edges").cast("double")), F.lit(0.0)) * 100
    return g.withColumn("percentage", rules.round_half_up(pct).cast("int"))
