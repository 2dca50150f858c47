"""Complexity reads a text once for the tokens that cannot overlap, not once for each of them."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from quarrylight.functions import text as tx

ODD = [
    "", "if", "else if (a) elseif else  if else\nif", "foreach for_ for4 _for for", "a&&b&&&c||||d|||e", "a ? b ?? c ??? d?", "x => y ==> z =>> w",
    "not-and-or.do;until:case", "ifif IF If élif ifé", "while(a)switch{case}catch except:rescue select elsif unless elif", None,
]


def one_by_one(t: str) -> int:
    left, right = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
    return sum(len(re.findall(p, t)) for p in [f"{left}else\\s+if{right}", *[left + w + right for w in tx._WORDS], "&&", r"\|\|", r"\?(?!\?)", "=>"])


def scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(")


def test_tokens_in_one_scan(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    out = df.select("t", tx.complexity_tokens(F.col("t")).alias("n"))
    assert {r["t"]: r["n"] for r in out.collect()} == {t: None if t is None else one_by_one(t) for t in ODD}
    assert scans(df.select(tx.complexity_tokens(F.col("t")))) <= 2


def test_complexity_without_strings_in_three_scans(spark):
    code = ["if (a) { // else if\n} else if (b && '? if') {}", 'x ? "a ?? b" : `c && d` # or\nwhile', "", "else\n\nif => 'unterminated || if"]
    df = spark.createDataFrame([(t,) for t in code], "t string")
    out = df.select("t", tx.strip_strings_and_comments(F.col("t")).alias("bare"), tx.cyclomatic_complexity(F.col("t")).alias("n"))
    assert [r["n"] for r in out.collect()] == [1 + one_by_one(r["bare"]) for r in out.collect()] == [5, 3, 1, 4]
    assert scans(df.select(tx.cyclomatic_complexity(F.col("t")))) <= 2
