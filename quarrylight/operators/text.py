"""Passes over file contents: duplication and security patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import security
from ..functions import text as tx


def chunks(files: DataFrame) -> DataFrame:
    """(file_path, chunk): a 128-bit hash of each distinct five-line window of a file. Only
    hashes are shuffled."""
    c = F.explode(F.transform(tx.line_chunks(F.col("content")), F.md5))
    return files.select("file_path", c.alias("chunk"))


def duplicate_chunks(files: DataFrame) -> DataFrame:
    """Chunks that several files have, with the number of files."""
    return chunks(files).groupBy("chunk").agg(F.count(F.lit(1)).alias("files")).filter("files > 1")


def duplication(files: DataFrame) -> DataFrame:
    """One row (chunks, duplicated, ratio)."""
    per = chunks(files).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    g = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicated"))
    return g.withColumn("ratio", F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("duplicated").cast("double"), F.col("chunks").cast("double")), F.lit(0.0))))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("file_path", "language", F.posexplode(F.split("content", "\n")).alias("pos", "line"))


def _scan(lines: DataFrame, finding, category: str, order: int) -> DataFrame:
    return (
        lines.withColumn("f", finding)
        .filter("f is not null")
        .select("file_path", F.lit(order).alias("scanner"), (F.col("pos") + 1).alias("line"), F.lit(category).alias("category"), "f.severity", "f.description", "f.line_text")
    )


def secrets(files: DataFrame) -> DataFrame:
    # one test of the whole file, then one of each line, before the rules are tried in turn
    hit = files.filter(F.col("content").rlike(security.ANY_SECRET))
    return _scan(_lines(hit).filter(F.col("line").rlike(security.ANY_SECRET)), security.secret(F.col("line")), "hardcoded-secret", 0)


def dynamic_execution(files: DataFrame) -> DataFrame:
    some = files.filter(F.col("language").isin(*security.EXECUTION))
    return _scan(_lines(some), security.dynamic_execution(F.col("language"), F.col("line")), "dynamic-code-execution", 1)


def child_process(files: DataFrame) -> DataFrame:
    some = files.filter(F.col("language").isin("javascript", "typescript") & F.col("content").rlike(security.CHILD_PROCESS_IMPORT))
    return _scan(_lines(some), security.child_process(F.col("line")), "dynamic-code-execution", 2)


def sql_injection(files: DataFrame) -> DataFrame:
    some = files.filter(F.col("content").rlike(r"(?i)\b(?:SELECT|INSERT|UPDATE|DELETE)\b"))
    return _scan(_lines(some), security.sql_injection(F.col("line")), "sql-injection-risk", 3)


def security_findings(files: DataFrame, most: int = 500) -> DataFrame:
    """Findings of all scanners in the order file, scanner, line; the first ``most`` of them."""
    found = reduce(DataFrame.unionByName, [secrets(files), dynamic_execution(files), child_process(files), sql_injection(files)])
    return found.orderBy("file_path", "scanner", "line").limit(most)


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")])


def file_complexity_tokens(files: DataFrame) -> DataFrame:
    return files.select("file_path", tx.complexity_tokens(F.col("content")).cast("long").alias("tokens"))
