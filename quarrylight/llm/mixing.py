"""Mixing sources to target weights (operator 2).

Each source gets a token budget. As many complete epochs as fit come first; what is left of
the budget is filled by Efraimidis-Spirakis sampling: document i has the exponential key
-ln(u_i) / w_i with its quality weight w_i, keys ascend within the source, and documents
are taken while the prefix sum of tokens before them is below the rest of the budget (the
document that crosses it is taken).

u_i comes from md5(doc_id), so the choice is a function of the data alone. A source is
never sorted as a whole: keys are mapped by a monotone function to ``BINS`` bins, token sums
per (source, bin) show the bin in which the budget ends, and only that bin is ordered.

Defined cases: null or blank texts have no tokens and are never selected; a null source is
the source ``''``; a null doc_id takes u of the empty string; a missing or null weight is
``default_weight``; keys that tie are ordered by doc_id (nulls first) and then by the text's
hash, and rows that agree in all of these are taken together; an empty table gives an
empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, discard, sized

BINS = 4096
ALPHA = 0.7
W_GOOD, W_BAD, W_UNKNOWN = 1.0, 0.2, 0.6


def n_tokens(text: Column) -> Column:
    """Number of pieces between single spaces and line ends, 0 for a null or blank text."""
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    pieces = F.length(flat) - F.length(F.replace(flat, F.lit(" "))) + 1
    return F.when(text.isNull() | (F.length(F.trim(flat)) == 0), 0).otherwise(pieces).cast("long")


def _uniform(doc_id: Column) -> Column:
    """(0, 1) from the first 52 bits of md5."""
    h = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def label_weights(labels: DataFrame) -> DataFrame:
    """(__label_id, __w) from labels(doc_id, quality): the largest quality of repeated rows counts."""
    q = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("__label_id"))
    return q.agg(F.max("quality").alias("q")).select("__label_id", F.when(F.col("q") >= 1, W_GOOD).otherwise(W_BAD).alias("__w"))


def _keyed(docs: DataFrame, weights: DataFrame, id_col: str, text: str, source: str, extra: list[str]) -> DataFrame:
    d = docs.select(
        *[F.col(c).alias(f"__x_{c}") for c in extra],
        F.col(id_col).alias("__id"),
        F.coalesce(F.col(source), F.lit("")).alias("__source"),
        n_tokens(F.col(text)).alias("__tokens"),
        F.xxhash64(F.col(text)).alias("__tie"),
    ).filter("__tokens > 0")
    w = F.coalesce(F.col("__w"), F.lit(W_UNKNOWN))
    key = -F.log(_uniform(F.col("__id"))) / w
    d = d.join(sized(weights), d["__id"] == weights["__label_id"], "left").drop("__label_id").withColumn("__key", key).drop("__w")
    return d.withColumn("__bin", F.floor((1 - F.exp(-F.col("__key") / 2)) * BINS).cast("int"))


def plan_sources(per_source: DataFrame, alpha: float, budget_ratio: float, weights: dict[str, float] | None) -> DataFrame:
    """(__source, __epochs, __rest) from (__source, t = tokens). The weight of a source is
    tokens ** alpha, or as ``weights`` says (sources it does not name get none)."""
    if weights is None:
        w = F.pow(F.col("t").cast("double"), F.lit(float(alpha)))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        w = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("__source")), F.lit(0.0)) if pairs else F.lit(0.0)
    s = per_source.withColumn("w", w)
    total = s.agg(F.sum("w").alias("sw"), F.sum("t").alias("st"))  # one row
    b = F.when(F.col("sw") > 0, F.floor(F.col("w") / F.col("sw") * F.col("st") * float(budget_ratio) + 0.5)).otherwise(0).cast("long")
    s = s.crossJoin(F.broadcast(total)).select("__source", "t", b.alias("b"))
    return s.select("__source", F.floor(F.col("b") / F.col("t")).cast("int").alias("__epochs"), (F.col("b") % F.col("t")).alias("__rest"))


def _limits(keyed: DataFrame, alpha: float, budget_ratio: float, weights: dict[str, float] | None) -> DataFrame:
    """Per source: epochs, and the last (bin, key, id, tie) that is taken besides."""
    keyed = keyed.select("__source", "__bin", "__key", "__id", "__tie", "__tokens")
    bins = cut(keyed.groupBy("__source", "__bin").agg(F.sum("__tokens").alias("t")))
    plan = plan_sources(bins.groupBy("__source").agg(F.sum("t").alias("t")), alpha, budget_ratio, weights)
    run = Window.partitionBy("__source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    # the bin in which the budget ends: some of it is left before the bin
    last = (
        bins.withColumn("before", F.coalesce(F.sum("t").over(run), F.lit(0)))
        .join(plan, "__source")
        .filter(F.col("before") < F.col("__rest"))
        .groupBy("__source")
        .agg(F.max("__bin").alias("__last"), F.max("before").alias("__before"), F.first("__rest").alias("__rest"))
    )
    last = cut(last)
    inside = keyed.join(sized(last), "__source").filter(F.col("__bin") == F.col("__last"))
    order = Window.partitionBy("__source").orderBy("__key", "__id", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    taken = inside.withColumn("before", F.col("__before") + F.coalesce(F.sum("__tokens").over(order), F.lit(0))).filter(
        F.col("before") < F.col("__rest")
    )
    end = taken.groupBy("__source").agg(F.max(F.struct("__key", "__id", "__tie")).alias("__end"), F.first("__last").alias("__last"))
    return cut(plan.join(end, "__source", "left").select("__source", "__epochs", "__last", "__end"))


def _copies() -> Column:
    here = F.struct("__key", "__id", "__tie")
    part = F.when(F.col("__end").isNull(), False).when(F.col("__bin") < F.col("__last"), True).otherwise((F.col("__bin") == F.col("__last")) & (here <= F.col("__end")))
    return F.col("__epochs") + part.cast("int")


def mix(
    docs: DataFrame,
    labels: DataFrame,
    alpha: float = ALPHA,
    budget_ratio: float = 1.0,
    weights: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per selected document: (doc_id, source, n_tokens, copies)."""
    w = cut(label_weights(labels))
    keyed = cut(_keyed(docs, w, id_col, text, source, []))
    limits = _limits(keyed, alpha, budget_ratio, weights)
    return (
        keyed.join(sized(limits), "__source")
        .withColumn("copies", _copies())
        .filter("copies > 0")
        .select(F.col("__id").alias(id_col), F.col("__source").alias("source"), F.col("__tokens").alias("n_tokens"), "copies")
    )


def mix_documents(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, budget_ratio: float = 1.0, weights: dict[str, float] | None = None) -> DataFrame:
    """The selected rows of ``docs``, each as often as it is to be seen, with the same columns."""
    w = cut(label_weights(labels))
    slim = cut(_keyed(docs, w, "doc_id", "text", "source", []))
    limits = _limits(slim, alpha, budget_ratio, weights)
    discard(slim)
    return (
        _keyed(docs, w, "doc_id", "text", "source", docs.columns)
        .join(sized(limits), "__source")
        .withColumn("__copy", F.explode(F.array_repeat(F.lit(1), _copies())))
        .select(*[F.col(f"__x_{c}").alias(c) for c in docs.columns])
    )


def sql(documents: str = "documents", labels: str = "labels", columns: str = "doc_id, source, n_tokens, copies") -> str:
    """DuckDB SQL of the same choice at the default parameters. ``columns`` may also name
    the columns of ``documents`` (as d.x)."""
    return f"""
WITH d0 AS (SELECT *, replace(text, chr(10), ' ') AS flat FROM {documents}),
d AS (SELECT *, CASE WHEN text IS NULL OR length(trim(flat)) = 0 THEN 0 ELSE length(flat) - length(replace(flat, ' ', '')) + 1 END AS n_tokens,
  coalesce(source, '') AS src FROM d0),
w AS (SELECT doc_id AS label_id, CASE WHEN max(quality) >= 1 THEN {W_GOOD}::DOUBLE ELSE {W_BAD}::DOUBLE END AS w
  FROM {labels} WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
k AS (SELECT d.*, -ln((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
  / coalesce(w, {W_UNKNOWN}::DOUBLE) AS key FROM d LEFT JOIN w ON doc_id = label_id WHERE n_tokens > 0),
s AS (SELECT src, sum(n_tokens)::BIGINT AS t, pow(sum(n_tokens)::DOUBLE, {ALPHA}::DOUBLE) AS wt FROM k GROUP BY src),
b AS (SELECT src, t, CAST(floor(wt / sum(wt) OVER () * (sum(t) OVER ())::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS budget FROM s),
e AS (SELECT src, budget // t AS epochs, budget % t AS rest FROM b),
r AS (SELECT k.*, epochs, rest, coalesce(sum(n_tokens) OVER (PARTITION BY k.src ORDER BY key, doc_id NULLS FIRST
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k JOIN e ON k.src = e.src),
c AS (SELECT * REPLACE (src AS source, n_tokens::BIGINT AS n_tokens), CAST(epochs + CASE WHEN before < rest THEN 1 ELSE 0 END AS INTEGER) AS copies FROM r)
SELECT {columns} FROM c WHERE copies > 0"""
