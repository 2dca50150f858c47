"""Dead code, call graph, entry points, complexity and repository totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths, rules


def node_id(name: Column, path: Column) -> Column:
    return F.concat(name, F.lit("@"), path)


def dead_code(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions whose name nobody calls: neither exactly, nor, from another language, up to
    case and separators. ``safe`` ones are neither exported nor in a test file."""
    default = F.coalesce("is_default_export", F.lit(False))
    f = functions.filter(~rules.is_likely_entry_point(F.col("file_path"), F.col("name"), default))
    called = calls.select(F.col("callee").alias("name")).distinct()
    # one row per spelling and language, so that a popular name does not multiply
    spelled = calls.select(paths.normalized_name(F.col("callee")).alias("spelled"), F.col("language").alias("from")).distinct()
    f = f.join(called, "name", "left_anti").withColumn("__spelled", paths.normalized_name(F.col("name")))
    dead = f.join(spelled, (F.col("__spelled") == F.col("spelled")) & (F.col("language") != F.col("from")), "left_anti").drop("__spelled")
    return dead.withColumn("safe", rules.is_safe_to_remove(F.col("file_path"), F.col("is_exported"))).withColumn("caller_count", F.lit(0))


def dead_ratio(functions: DataFrame, dead: DataFrame) -> DataFrame:
    """One row (total_functions, dead_functions, safe_functions, safe_ratio)."""
    total = functions.agg(F.count(F.lit(1)).alias("total_functions"))
    d = dead.agg(F.count(F.lit(1)).alias("dead_functions"), F.count_if("safe").alias("safe_functions"))
    ratio = F.coalesce(F.try_divide(F.col("safe_functions").cast("double"), F.col("total_functions").cast("double")), F.lit(0.0))
    return total.crossJoin(d).withColumn("safe_ratio", ratio)


def call_edges(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(source, target) node ids; a name that several functions have means the last of them."""
    last = functions.groupBy("name").agg(
        F.max_by(node_id(F.col("name"), F.col("file_path")), F.struct("file_path", "fn_ord")).alias("target")
    )
    c = calls.filter("caller is not null").select(F.col("caller").alias("source"), F.col("callee").alias("name")).distinct()
    return c.join(last, "name").select("source", "target").distinct()


def call_nodes(functions: DataFrame, dead: DataFrame, entries: DataFrame) -> DataFrame:
    """Nodes with flags; flags go by name alone."""
    d = dead.select("name", F.lit(True).alias("is_dead")).distinct()
    e = entries.select("name", F.lit(True).alias("is_entry_point")).distinct()
    return (
        functions.join(d, "name", "left")
        .join(e, "name", "left")
        .select(
            node_id(F.col("name"), F.col("file_path")).alias("id"), "name", "file_path", "language", "complexity", "is_exported",
            F.coalesce("is_entry_point", F.lit(False)).alias("is_entry_point"), F.coalesce("is_dead", F.lit(False)).alias("is_dead"),
            "line_count", "start_line", "fn_ord",
        )
    )


def entry_points(functions: DataFrame, root: str = "") -> DataFrame:
    """(name, file_path, start_line, type, description, language), the first of a name in a file. A
    server file has the language of the first function that serves."""
    path = F.col("file_path")
    rel = F.when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 1 << 20)).otherwise(path) if root else path
    ep = rules.entry_point_of_function(path, rel, F.col("name"), F.coalesce("is_default_export", F.lit(False)))
    by_fn = functions.withColumn("ep", ep).filter("ep is not null").select("name", "file_path", "start_line", "ep.*", "language", F.lit(1).alias("kind"), "fn_ord", F.lit(None).cast("long").alias("serves"))
    base = paths.basename(path)
    serving = functions.filter(F.lower(base).isin(*rules.SERVER_FILES) & (F.col("language") != "unknown") & F.lower("name").isin(*rules.SERVER_FUNCTIONS))
    by_file = serving.groupBy("file_path", "language").agg(F.min("fn_ord").cast("long").alias("serves")).select(
        base.alias("name"), "file_path", F.lit(1).alias("start_line"), F.lit("server").alias("type"),
        F.concat(base, F.lit(" - HTTP server entry point")).alias("description"), "language", F.lit(0).alias("kind"), F.lit(0).alias("fn_ord"), "serves",
    )
    first = Window.partitionBy("name", "file_path").orderBy("kind", "fn_ord", "serves", "language")
    found = by_fn.withColumn("fn_ord", F.col("fn_ord").cast("long")).unionByName(by_file.withColumn("fn_ord", F.col("fn_ord").cast("long")))
    return found.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "kind", "fn_ord", "serves")


def file_complexity(functions: DataFrame) -> DataFrame:
    avg = rules.round_half_up(F.avg("complexity"), 2)
    g = functions.groupBy("file_path").agg(
        avg.alias("avg_complexity"), F.max("complexity").alias("max_complexity"), F.count(F.lit(1)).alias("functions")
    )
    return g.withColumn("level", rules.complexity_level(F.col("avg_complexity"))).orderBy(F.desc("avg_complexity"), "file_path")


def repo_complexity(functions: DataFrame) -> DataFrame:
    return functions.agg(
        F.coalesce(rules.round_half_up(F.avg("complexity"), 2), F.lit(1.0)).alias("avg_complexity"),
        F.coalesce(F.max("complexity"), F.lit(1)).alias("max_complexity"),
    )


def most_complex(functions: DataFrame, k: int = 20) -> DataFrame:
    top = functions.orderBy(F.desc("complexity"), "file_path", "fn_ord").limit(k)
    return top.select("name", "file_path", "fn_ord", "complexity", rules.complexity_level(F.col("complexity")).alias("level"))


def repo_totals(files: DataFrame, functions: DataFrame) -> DataFrame:
    f = files.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("total_lines"))
    return f.crossJoin(functions.agg(F.count(F.lit(1)).alias("total_functions")))


def file_ratios(files: DataFrame, oversized: int = 300) -> DataFrame:
    n = F.count(F.lit(1)).cast("double")

    def share(flag: Column) -> Column:
        return F.coalesce(F.try_divide(F.count_if(flag).cast("double"), n), F.lit(0.0))

    return files.agg(share(paths.is_test_file(F.col("file_path"))).alias("test_ratio"), share(F.col("line_count") > oversized).alias("oversized_ratio"))


def language_breakdown(files: DataFrame) -> DataFrame:
    """(language, lines, percentage, is_primary): percentages are rounded before the largest is taken."""
    g = files.groupBy("language").agg(F.sum("line_count").alias("lines"))
    share = F.col("lines") / F.sum("lines").over(Window.partitionBy()) * 100
    g = g.withColumn("percentage", rules.round_half_up(share).cast("int"))
    first = Window.orderBy(F.desc("percentage"), "language")
    return g.withColumn("is_primary", F.row_number().over(first) == 1)


def health(inputs: DataFrame) -> DataFrame:
    """Score, grade and the six parts from one row of ratios."""
    p = rules.health_parts(*[F.col(c) for c in ("dead_ratio", "avg_complexity", "max_complexity", "test_ratio", "duplication_ratio", "oversized_ratio")])
    out = inputs.select(rules.health_score(p).alias("score"), *[v.alias(k) for k, v in p.items()])
    return out.withColumn("grade", rules.grade(F.col("score")))
