"""The whole analysis of a source tree in one call, and what is done with its result."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import code, deps, graph, history
from .operators import text as passes
from .parse import registry
from .session import ship_package
from .sources import gitlog, manifests, tree


@dataclass
class History:
    touches: DataFrame
    ownership: DataFrame
    contributors: DataFrame
    bus_factor: DataFrame
    churn: DataFrame
    window: DataFrame


@dataclass
class Analysis:
    """Lazily evaluated tables; ``close`` gives back what is kept for them."""

    root: str
    analyzed_at: str
    truncated: bool
    is_monorepo: bool
    parsed: DataFrame
    files: DataFrame
    functions: DataFrame
    calls: DataFrame
    imports: DataFrame
    totals: DataFrame
    languages: DataFrame
    dead_code: DataFrame
    dead_ratio: DataFrame
    entry_points: DataFrame
    nodes: DataFrame
    edges: DataFrame
    complexity: DataFrame
    file_complexity: DataFrame
    most_complex: DataFrame
    explanations: DataFrame
    onboarding: DataFrame
    coverage: DataFrame
    undeclared: DataFrame
    dependencies: DataFrame
    duplication: DataFrame
    findings: DataFrame
    severities: DataFrame
    health: DataFrame
    history: History | None

    def close(self) -> None:
        for df in (self.parsed, self.dead_code, self.findings):
            df.unpersist()


def git_history(spark: SparkSession, root: str) -> History | None:
    """Ownership, bus factor and churn; None where there is no history to read."""
    t = gitlog.touches(spark, root)
    if t is None:
        return None
    return History(t, history.ownership(t), history.top_contributors(t), history.bus_factor(t), history.high_churn(t), history.window_of(t))


def analyze_files(spark: SparkSession, contents: DataFrame, root: str = "") -> Analysis:
    """The analysis of ``contents``(file_path, content), from wherever they come; no manifests
    and no history are read. Without any file all tables are empty, and health is that of a
    repository whose average and largest complexity are 1."""
    return _analyze(spark, contents, root, False, manifests.Workspace(False), [], None)


def analyze(spark: SparkSession, root: str, max_files: int = tree.MAX_FILES) -> Analysis:
    """The analysis of a directory. Contents are read by two passes over the tree, one to parse and
    one for the passes over text, and never kept."""
    files, truncated = tree.walk(spark, root, max_files=max_files)
    return _analyze(spark, files, root, truncated, manifests.workspace(root), manifests.aliases(root), git_history(spark, root))


def _analyze(spark: SparkSession, contents: DataFrame, root: str, truncated: bool, found: manifests.Workspace, alias_rows: list, log: History | None) -> Analysis:
    ship_package(spark)
    parsed = registry.parse_files(contents).persist(StorageLevel.MEMORY_AND_DISK)
    files, functions, calls, imports = (f(parsed) for f in (registry.files_of, registry.functions_of, registry.calls_of, registry.imports_of))
    dead = code.dead_code(functions, calls).persist(StorageLevel.MEMORY_AND_DISK)
    entries = code.entry_points(functions, root.rstrip("/"))
    nodes, edges = code.call_nodes(functions, dead, entries), code.call_edges(functions, calls)
    aliased = manifests.alias_table(spark, alias_rows) if alias_rows else None
    undeclared = deps.undeclared_imports(imports, manifests.declared(spark, found), aliased)
    text = contents.select("file_path", "content").join(files.select("file_path", "language"), "file_path")
    findings = passes.security_findings(text).persist(StorageLevel.MEMORY_AND_DISK)
    ratio = code.dead_ratio(functions, dead)
    duplication, complexity = passes.duplication(text), code.repo_complexity(functions)
    inputs = (
        ratio.select(F.col("safe_ratio").alias("dead_ratio"))
        .crossJoin(complexity)
        .crossJoin(code.file_ratios(files))
        .crossJoin(duplication.select(F.col("ratio").alias("duplication_ratio")))
    )
    stops = graph.onboarding_stops(files, nodes, edges, entries)
    return Analysis(
        root=root, analyzed_at=datetime.now(UTC).isoformat(), truncated=truncated, is_monorepo=found.is_monorepo, parsed=parsed, files=files, functions=functions,
        calls=calls, imports=imports, totals=code.repo_totals(files, functions), languages=code.language_breakdown(files), dead_code=dead, dead_ratio=ratio,
        entry_points=entries, nodes=nodes, edges=edges, complexity=complexity, file_complexity=code.file_complexity(functions),
        most_complex=code.most_complex(functions), explanations=deps.explain_files(files), onboarding=stops, coverage=graph.edge_coverage(nodes, edges, stops),
        undeclared=undeclared, dependencies=graph.dependency_edges(imports, files), duplication=duplication, findings=findings,
        severities=passes.severity_counts(findings), health=code.health(inputs), history=log,
    )


# -- sinks --


def _rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """One row with the table as an ordered array."""
    cols = [*order, *[c for c in df.columns if c not in order]]
    return df.agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))


def document(a: Analysis) -> DataFrame:
    """One row: the analysis as nested columns, as the JSON sink writes it. It is one document by
    its nature; for large trees write the tables themselves, with ``save``."""
    one = a.totals.select(F.lit(a.root).alias("root"), F.lit(a.analyzed_at).alias("analyzed_at"), F.lit(a.truncated).alias("truncated"), F.lit(a.is_monorepo).alias("is_monorepo"), "*")
    for df, name in ((a.health, "health"), (a.complexity, "complexity"), (a.duplication, "duplication"), (a.severities, "severities"), (a.dead_ratio, "dead_ratio"), (a.coverage, "coverage")):
        one = one.crossJoin(df.select(F.struct("*").alias(name)))
    tables = [
        (a.languages, ["language"], "languages"), (a.dead_code.select("file_path", "fn_ord", "name", "start_line", "language", "safe"), ["file_path", "fn_ord"], "dead_code"),
        (a.entry_points, ["file_path", "start_line"], "entry_points"), (a.nodes, ["id"], "nodes"), (a.edges, ["source", "target"], "edges"),
        (a.most_complex, ["complexity", "file_path"], "most_complex"), (a.file_complexity, ["file_path"], "file_complexity"), (a.explanations, ["file_path"], "explanations"),
        (a.onboarding, ["file_path"], "onboarding"), (a.undeclared, ["package"], "undeclared"), (a.dependencies, ["target", "dependent"], "dependencies"),
        (a.findings, ["file_path", "scanner", "line"], "findings"),
    ]
    if a.history:
        tables += [(a.history.ownership.drop("first"), ["file_path", "rank"], "ownership"), (a.history.contributors, ["email"], "contributors"), (a.history.churn, ["file_path"], "churn")]
        one = one.crossJoin(a.history.bus_factor.select(F.struct("*").alias("bus_factor"))).crossJoin(a.history.window.select(F.struct("*").alias("history_window")))
    for df, order, name in tables:
        one = one.crossJoin(_rows(df, order, name))
    return one


def to_json(a: Analysis) -> str:
    return document(a).select(F.to_json(F.struct("*"))).first()[0]


def save(a: Analysis, path: str) -> None:
    """Every table as Parquet under ``path``, the snapshot that later comparisons read."""
    for name in ("files", "functions", "calls", "imports", "totals", "languages", "dead_code", "entry_points", "nodes", "edges", "dependencies", "findings", "health", "complexity"):
        getattr(a, name).write.mode("overwrite").parquet(f"{path}/{name}")


def snapshot(a: Analysis) -> DataFrame:
    """One row (score, grade, dead, avg_complexity, functions) for ``deps.snapshot_diff``."""
    counts = a.dead_ratio.select(F.col("dead_functions").alias("dead"), F.col("total_functions").alias("functions"))
    return a.health.select("score", "grade").crossJoin(counts).crossJoin(a.complexity.select("avg_complexity"))


def compare(previous: Analysis, current: Analysis) -> DataFrame:
    """One row of deltas with a summary."""
    return deps.snapshot_diff(snapshot(previous), snapshot(current), deps.dead_diff(previous.dead_code, current.dead_code))


def health_line(a: Analysis) -> str:
    h = a.health.select("score", "grade").first()
    return f"{h['score']} {h['grade']}"


def dead_listing(a: Analysis) -> list[str]:
    """``folder/file:line<TAB>name`` of every dead function, in file order."""
    tail = F.array_join(F.slice(F.split("file_path", r"[/\\]"), -2, 2), "/")
    whole = F.when(F.size(F.split("file_path", r"[/\\]")) < 2, F.col("file_path")).otherwise(tail)
    lines = a.dead_code.orderBy("file_path", "fn_ord").select(F.concat(whole, F.lit(":"), "start_line", F.lit("\t"), "name"))
    return [r[0] for r in lines.toLocalIterator()]


def report(a: Analysis, shown: int = 10) -> str:
    """A page for the console."""
    t, h, c, d = a.totals.first(), a.health.first(), a.complexity.first(), a.dead_ratio.first()
    s, u = a.severities.first(), a.duplication.first()
    lines = [
        f"{a.root}  ({a.analyzed_at})", "",
        f"  Health       {h['score']} ({h['grade']})", f"  Files        {t['total_files']:,}" + ("  (limit reached)" if a.truncated else ""),
        f"  Lines        {t['total_lines']:,}", f"  Functions    {t['total_functions']:,}",
        f"  Dead         {d['dead_functions']:,}, of which {d['safe_functions']:,} can be removed ({100 * d['safe_ratio']:.1f} %)",
        f"  Complexity   {c['avg_complexity']} on average, {c['max_complexity']} at most", f"  Duplication  {100 * u['ratio']:.1f} %",
        f"  Security     {s['high']} high, {s['medium']} medium, {s['low']} low",
        "  Languages    " + ", ".join(f"{r['language']} {r['percentage']} %" for r in a.languages.orderBy(F.desc("lines"), "language").take(shown)),
    ]
    first = a.dead_code.orderBy("file_path", "fn_ord").select("name", "file_path", "start_line").take(shown)
    if first:
        lines += ["", "  Dead functions"] + [f"    {r['name']}  {r['file_path']}:{r['start_line']}" for r in first]
    if d["dead_functions"] > shown:
        lines.append(f"    ... and {d['dead_functions'] - shown} more")
    return "\n".join(lines)
