"""Quality rules at host level (operator 5).

Every document is tested by a few rules. Failures are aggregated by host, each host's
failure rate is shrunk towards the corpus by an empirical beta prior (method of moments
over hosts), and the host's verdict is joined back to its documents:

* ``bad`` host (shrunk rate >= ``bad_rate``): all its documents are rejected;
* ``watch`` host: a document is rejected when it fails one rule;
* ``trusted`` host (shrunk rate < ``trusted_rate``): it takes two failed rules.

Defined cases: a null or blank text fails the rule ``blank`` and no other, and is always
rejected; a null source is the host ``''``; repeated rows count and are judged one by one;
with fewer than two hosts, or no spread between them, the prior has ``default_strength``
pseudo-documents at the corpus rate, and its strength is kept between 1 and 10,000 in any case; a
rate equal to ``bad_rate`` is bad, one equal to ``trusted_rate`` is watched; an empty table gives an
empty result. Other columns are never read, and ``filter_documents`` gives all columns new names
inside, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sized

SYMBOLS = "!#$%&*|"
BAD_RATE, TRUSTED_RATE, DEFAULT_STRENGTH = 0.5, 0.01, 10.0


def rule_flags(text: Column) -> dict[str, Column]:
    """Rule name -> boolean column (true: failed)."""
    n = F.length(text)
    one = F.replace(text, F.lit("\n"), F.lit(" "))
    words = n - F.length(F.replace(one, F.lit(" "))) + 1  # counted without being cut out
    blank = text.isNull() | ~text.rlike("[^ \n]")
    return {
        "blank": blank,
        "symbols": ~blank & (F.regexp_count(text, F.lit("[!#$%&*|]")) > words * 0.1),
        "upper": ~blank & (words >= 20) & (F.regexp_count(text, F.lit("[A-Z]")) > n * 0.3),
        "repeated": ~blank & (words >= 8) & (F.size(F.array_distinct(F.split(one, " "))) < words * 0.3),
    }


def _failures(docs: DataFrame, text: str, source: str, keep: list[str]) -> DataFrame:
    flags = rule_flags(F.col(text))
    return docs.select(
        *[F.col(c) for c in keep],
        F.coalesce(F.lower(F.col(source)), F.lit("")).alias("__host"),
        flags["blank"].cast("int").alias("__blank"),
        F.coalesce(sum((f.cast("int") for f in flags.values()), F.lit(0)), F.lit(0)).alias("__failed"),
    )


def host_verdicts(
    failures: DataFrame, bad_rate: float = BAD_RATE, trusted_rate: float = TRUSTED_RATE, default_strength: float = DEFAULT_STRENGTH
) -> DataFrame:
    """(__host, __rate, __verdict) from rows with __host and __failed."""
    hosts = failures.groupBy("__host").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("__failed") > 0).cast("long")).alias("bad")
    )
    r = F.col("bad") / F.col("n")
    prior = hosts.agg(
        (F.sum("bad") / F.sum("n")).alias("m"), F.avg(r).alias("mu"), F.coalesce(F.var_samp(r), F.lit(0.0)).alias("v")
    ).select(
        "m",
        F.when((F.col("v") <= 1e-12) | (F.col("mu") * (1 - F.col("mu")) <= F.col("v")), F.lit(float(default_strength)))
        .otherwise(F.least(F.lit(10000.0), F.greatest(F.lit(1.0), F.col("mu") * (1 - F.col("mu")) / F.col("v") - 1)))
        .alias("k"),
    )
    rate = (F.col("bad") + F.col("k") * F.col("m")) / (F.col("n") + F.col("k"))
    # the prior is one row by construction
    return hosts.crossJoin(F.broadcast(prior)).select(
        "__host",
        F.floor(rate * 1000000 + 0.5).cast("long").alias("__rate"),
        F.when(rate >= bad_rate, "bad").when(rate < trusted_rate, "trusted").otherwise("watch").alias("__verdict"),
    )


def _keep() -> Column:
    need = F.when(F.col("__verdict") == "trusted", 2).otherwise(1)
    return (F.col("__verdict") != "bad") & (F.col("__blank") == 0) & (F.col("__failed") < need)


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **limits: float) -> DataFrame:
    """One row per document: (id, host, n_failed, host_rate_ppm, host_verdict, keep)."""
    failures = cut(_failures(docs, text, source, [id_col]))
    verdicts = cut(host_verdicts(failures, **limits))
    return failures.join(sized(verdicts), "__host").select(
        F.col(id_col),
        F.col("__host").alias("host"),
        F.col("__failed").alias("n_failed"),
        F.col("__rate").alias("host_rate_ppm"),
        F.col("__verdict").alias("host_verdict"),
        _keep().alias("keep"),
    )


def filter_documents(docs: DataFrame, text: str = "text", source: str = "source", **limits: float) -> DataFrame:
    """The rows of ``docs`` that are kept, with the same columns. The rules are evaluated once for
    the verdicts and once for the filter, into columns that are never null, so that no join
    condition repeats them."""
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    d = docs.toDF(*inner.values())
    verdicts = cut(host_verdicts(_failures(d, inner[text], inner[source], []), **limits))
    mild = verdicts.filter("__verdict <> 'bad'").select("__host", F.when(F.col("__verdict") == "trusted", 2).otherwise(1).alias("__need"))
    host = F.coalesce(F.lower(F.col(inner[source])), F.lit(""))
    x = d.withColumn("__host", host).join(sized(cut(mild)), "__host")
    return x.filter(_kept(F.col(inner[text]), F.col("__need"))).select(*inner.values()).toDF(*docs.columns)


def _kept(text: Column, need: Column) -> Column:
    """Not blank, and fewer failed rules than ``need``; one pass, in the order of the rules' cost."""
    flags = rule_flags(text)
    blank = flags.pop("blank")
    return ~blank & (sum((f.cast("int") for f in flags.values()), F.lit(0)) < need)


def sql(columns: str, where: str = "", documents: str = "documents") -> str:
    """DuckDB SQL of the same rules; ``columns`` is the select list over (d.*, host, n_failed,
    host_rate_ppm, host_verdict, keep)."""
    return f"""
WITH t AS (SELECT *, string_split(replace(text, chr(10), ' '), ' ') AS toks FROM {documents}),
b AS (SELECT *, len(toks) AS words, (text IS NULL OR length(trim(replace(text, chr(10), ' '))) = 0) AS blank FROM t),
f AS (SELECT *, coalesce(lower(source), '') AS host, blank::INT AS r0,
  coalesce(NOT blank AND length(text) - length(translate(text, '{SYMBOLS}', '')) > words * 0.1::DOUBLE, false)::INT
  + coalesce(NOT blank AND words >= 20 AND length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) > length(text) * 0.3::DOUBLE, false)::INT
  + coalesce(NOT blank AND words >= 8 AND len(list_distinct(toks)) < words * 0.3::DOUBLE, false)::INT + blank::INT AS n_failed FROM b),
h AS (SELECT host, count(*) AS n, sum((n_failed > 0)::INT) AS bad FROM f GROUP BY host),
p AS (SELECT sum(bad)::DOUBLE / sum(n) AS m, avg(bad::DOUBLE / n) AS mu, coalesce(var_samp(bad::DOUBLE / n), 0) AS v FROM h),
k AS (SELECT m, CASE WHEN v <= 1e-12 OR mu * (1 - mu) <= v THEN {DEFAULT_STRENGTH}::DOUBLE ELSE least(10000.0::DOUBLE, greatest(1.0::DOUBLE, mu * (1 - mu) / v - 1)) END AS k FROM p),
r AS (SELECT host, (bad + k * m) / (n + k) AS rate FROM h, k),
v AS (SELECT host, CAST(floor(rate * 1000000 + 0.5) AS BIGINT) AS host_rate_ppm,
  CASE WHEN rate >= {BAD_RATE}::DOUBLE THEN 'bad' WHEN rate < {TRUSTED_RATE}::DOUBLE THEN 'trusted' ELSE 'watch' END AS host_verdict FROM r),
j AS (SELECT f.*, host_rate_ppm, host_verdict,
  host_verdict <> 'bad' AND r0 = 0 AND n_failed < CASE WHEN host_verdict = 'trusted' THEN 2 ELSE 1 END AS keep FROM f JOIN v USING (host))
SELECT {columns} FROM j {where}"""
