"""Dependency hygiene, nearest configuration and path aliases; file purposes; snapshot diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, rules


def nearest(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """(file_path, dir): the deepest directory of ``dirs``(dir) that contains the file.

    Files are joined by each of their ancestors, an equi-join instead of a prefix comparison
    of all pairs."""
    d = dirs.select(F.col("dir"), F.regexp_replace(paths.slashes(F.col("dir")), "/$", "").alias("__at")).distinct()
    f = files.select("file_path").distinct().withColumn("__at", F.explode(paths.ancestors(F.col("file_path"))))
    return f.join(d, "__at").groupBy("file_path").agg(F.max_by("dir", F.length("__at")).alias("dir"))


def alias_imports(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """Imports that a path alias or base URL of the nearest ``aliases``(dir, patterns, base_names) explains."""
    at = nearest(imports, aliases)
    full = imports.join(at, "file_path").join(aliases, "dir")
    star = F.exists(
        "patterns",
        lambda p: F.when(
            p.contains("*"),
            F.col("source").startswith(F.substring_index(p, "*", 1))
            & F.col("source").endswith(F.element_at(F.split(p, r"\*"), -1))
            & (F.length("source") >= F.length(p) - 1),
        ).otherwise(F.col("source") == p),
    )
    first = F.element_at(F.split("source", "/"), 1)
    based = F.coalesce(F.array_contains("base_names", first), F.lit(False))
    return full.filter((star | based) & ~F.col("source").startswith(".")).select("file_path", "source").distinct()


def undeclared_imports(imports: DataFrame, declared: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(package, files, imported_from): packages that are imported and nowhere declared, those
    that most files import first. ``declared``(package) has a row with a null package for every
    manifest that declares nothing; without any row there is no manifest, and nothing to hold
    imports against, so the result is empty."""
    i = imports.join(F.broadcast(declared.agg(F.count(F.lit(1)).alias("__n")).filter("__n > 0").select()), how="cross")
    if aliases is not None:
        i = i.join(alias_imports(imports, aliases), ["file_path", "source"], "left_anti")
    used = i.select("file_path", rules.package_name(F.col("source")).alias("package")).filter("package is not null").distinct()
    open_ = used.join(declared.select("package").filter("package is not null").distinct(), "package", "left_anti")
    g = open_.groupBy("package").agg(F.array_sort(F.collect_set("file_path")).alias("imported_from"))
    return g.select("package", F.size("imported_from").alias("files"), "imported_from").orderBy(F.desc("files"), "package")


def explain_files(files: DataFrame) -> DataFrame:
    """(file_path, purpose, explanation) from counts and the parser's sentence."""
    return files.select(
        "file_path",
        rules.purpose(F.col("n_exports"), F.col("n_imports"), F.col("n_functions")).alias("purpose"),
        rules.explanation(F.col("file_path"), F.coalesce("explanation", F.lit("")), F.col("n_functions"), F.col("language")).alias("explanation"),
    )


def dead_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(name, change): names of dead functions that are new, or resolved; names repeat as often as they occur."""
    new = current.select("name").join(previous.select("name").distinct(), "name", "left_anti").withColumn("change", F.lit("new"))
    gone = previous.select("name").join(current.select("name").distinct(), "name", "left_anti").withColumn("change", F.lit("resolved"))
    return new.unionByName(gone)


def snapshot_diff(previous: DataFrame, current: DataFrame, changes: DataFrame) -> DataFrame:
    """One row of deltas and a summary from two rows (score, grade, dead, avg_complexity, functions)."""
    p = previous.select(*[F.col(c).alias(f"p_{c}") for c in previous.columns])
    n = changes.agg(F.count_if(F.col("change") == "new").alias("new_dead"), F.count_if(F.col("change") == "resolved").alias("resolved_dead"))
    x = current.crossJoin(p).crossJoin(n).select(
        (F.col("score") - F.col("p_score")).alias("score_delta"), F.col("p_grade").alias("previous_grade"), F.col("grade").alias("current_grade"),
        (F.col("grade") != F.col("p_grade")).alias("grade_changed"), (F.col("dead") - F.col("p_dead")).alias("dead_delta"), "new_dead", "resolved_dead",
        rules.round_half_up(F.col("avg_complexity") - F.col("p_avg_complexity"), 2).alias("avg_complexity_delta"),
        (F.col("functions") - F.col("p_functions")).alias("functions_delta"),
    )
    return x.withColumn("summary", _sentences())


def _sentences():
    score = F.col("score_delta")
    arrow = F.when(score > 0, "↑").otherwise("↓")
    grades = F.when(F.col("grade_changed"), F.concat(F.lit(" ("), "previous_grade", F.lit(" → "), "current_grade", F.lit(")"))).otherwise("")
    head = F.when(score == 0, "Health score unchanged.").otherwise(F.concat(F.lit("Health score "), arrow, F.abs(score).cast("string"), grades, F.lit(".")))

    def many(c: str, text: str, end: str):
        return F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text), F.when(F.col(c) == 1, "").otherwise("s"), F.lit(end)))

    avg = F.col("avg_complexity_delta")
    shown = F.regexp_replace(F.format_string("%.2f", F.abs(avg)), r"\.?0+$", "")
    fns = F.col("functions_delta")
    return F.concat_ws(
        " ",
        head,
        many("new_dead", " new dead function", "."),
        many("resolved_dead", " dead function", " cleaned up."),
        F.when(avg != 0, F.concat(F.lit("Avg complexity "), F.when(avg > 0, "up ").otherwise("down "), shown, F.lit("."))),
        F.when(fns != 0, F.concat(F.when(fns > 0, "+").otherwise(""), fns.cast("string"), F.lit(" functions."))),
    )
