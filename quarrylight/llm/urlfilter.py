"""URL filters by a path-template tree (operator 1).

For each host the paths form a tree of segments. Digits are generalised first; then, level by
level, segments of a node with more than ``max_children`` different ones and less than
``min_share`` of its pages become the wildcard ``*``. From the deepest level up, sibling
branches with the same rest of the template, with labels, whose rates do not differ from that of
the other siblings (two-sided test: chi-square of at most ``z2``) are merged into ``*``; a branch
without any label is like nothing and stays by itself, and so does one whose siblings have none. A template whose smoothed share of bad
labels, (bad + strength * corpus rate) / (labelled + strength), exceeds ``max_bad`` is
rejected with all its pages.

The tree is learned on the distinct (host, generalised path) rows, not on pages, and pages
are joined to their verdict by that key.

Levels are as many as the deepest path has. Each step is one aggregation by the branch and one join
with its parent, both by equality, so no task holds the segments of a host.

Defined cases: a URL that is null or has no scheme and host has no template and is never
rejected; an empty path is the template ``/``, and paths of more than ``DEEPEST`` segments have the rest of
them as their last one; a chi-square equal to ``z2`` merges, a rate equal to ``max_bad`` is kept;
pages without a label count in a template's pages only; without any labels nothing is
rejected; repeated rows count; an empty table gives an empty result. ``labelled`` pages carry
0 (good), 1 (bad) or null in the column named ``bad``; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, sized

#: No real URL gets there (addresses end at a few thousand characters), but plans must end.
DEEPEST = 40
#: Levels of the SQL below.
SQL_LEVELS = 6
MAX_CHILDREN, MIN_SHARE, Z2, STRENGTH, MAX_BAD = 8, 0.05, 3.84, 20.0, 0.5
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
_PATH = r"^[^:]*://[^/?#]*([^?#]*)"


def _host(url: Column) -> Column:
    h = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), "^.*@", "")
    return F.coalesce(F.regexp_replace(h, ":[0-9]*$", ""), F.lit(""))


def _shape(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.regexp_extract(url, _PATH, 1), "[0-9]+", "{n}"), F.lit(""))


def _parts(shape: Column) -> Column:
    p = F.filter(F.split(shape, "/"), lambda x: x != "")
    rest = F.array_join(F.slice(p, DEEPEST, F.greatest(F.size(p) - (DEEPEST - 1), F.lit(0))), "/")
    return F.when(F.size(p) <= DEEPEST, p).otherwise(F.concat(F.slice(p, 1, DEEPEST - 1), F.array(rest)))


def learn(shapes: DataFrame, max_children: int = MAX_CHILDREN, min_share: float = MIN_SHARE, z2: float = Z2) -> DataFrame:
    """(__host, __shape, __t = segments of the template) from (__host, __shape, n, lab, bad)."""
    s = cut(shapes.withColumn("__t", _parts(F.col("__shape"))))
    deepest = s.agg(F.coalesce(F.max(F.size("__t")), F.lit(0))).first()[0]
    for d in range(deepest):
        # children of the node that the segments before this one are
        node = F.slice("__t", 1, d)
        child = s.filter(F.size("__t") > d).groupBy("__host", node.alias("__node"), F.get("__t", F.lit(d)).alias("__seg")).agg(F.sum("n").alias("__cn"))
        ends = s.filter(F.size("__t") == d).groupBy("__host", F.col("__t").alias("__node")).agg(F.sum("n").alias("__en"))
        kinds = child.groupBy("__host", "__node").agg(F.count(F.lit(1)).alias("__kinds"), F.sum("__cn").alias("__nn"))
        kinds = kinds.join(ends, ["__host", "__node"], "left").select(
            "__host", "__node", F.col("__kinds") + F.when(F.col("__en").isNotNull(), 1).otherwise(0) > max_children, F.col("__nn") + F.coalesce("__en", F.lit(0))
        ).toDF("__host", "__node", "__many", "__nn")
        wild = child.join(kinds.filter("__many"), ["__host", "__node"]).filter(F.col("__cn") < F.col("__nn") * min_share).select("__host", "__node", "__seg", F.lit(True).alias("__wild"))
        at = s.withColumn("__node", node).withColumn("__seg", F.get("__t", F.lit(d)))
        star = F.concat(F.col("__node"), F.array(F.lit("*")), F.slice("__t", d + 2, DEEPEST))
        s = _again(s, at.join(wild, ["__host", "__node", "__seg"], "left").withColumn("__t", F.when(F.col("__wild"), star).otherwise(F.col("__t"))))
    for d in range(deepest - 1, -1, -1):
        # siblings agree in everything but this segment
        rest = F.array_join(F.concat(F.slice("__t", 1, d), F.array(F.lit("")), F.slice("__t", d + 2, DEEPEST)), "/")
        at = s.withColumn("__rest", F.when(F.size("__t") > d, rest)).withColumn("__seg", F.get("__t", F.lit(d)))
        branch = at.filter("__rest is not null").groupBy("__host", "__rest", "__seg").agg(F.sum("lab").cast("double").alias("__l"), F.sum("bad").cast("double").alias("__b"))
        pool = branch.groupBy("__host", "__rest").agg(F.sum("__l").alias("__L"), F.sum("__b").alias("__B")).withColumnsRenamed({"__L": "__all", "__B": "__allbad"})
        l, b, al, ab = (F.col(c) for c in ("__l", "__b", "__all", "__allbad"))
        gap = b * al - l * ab
        # of branch and others: chi-square = gap ** 2 * all / (l * (all - l) * allbad * (all - allbad))
        like = (l > 0) & (al > l) & (gap * gap * al <= F.lit(float(z2)) * l * (al - l) * ab * (al - ab))
        alike = branch.join(pool, ["__host", "__rest"]).filter(like).select("__host", "__rest", "__seg")
        several = alike.groupBy("__host", "__rest").agg(F.count(F.lit(1)).alias("__k")).filter("__k > 1").select("__host", "__rest")
        merged = alike.join(several, ["__host", "__rest"]).withColumn("__like", F.lit(True))
        star = F.concat(F.slice("__t", 1, d), F.array(F.lit("*")), F.slice("__t", d + 2, DEEPEST))
        s = _again(s, at.join(merged, ["__host", "__rest", "__seg"], "left").withColumn("__t", F.when(F.col("__like"), star).otherwise(F.col("__t"))))
    return s


def _again(old: DataFrame, new: DataFrame) -> DataFrame:
    out = cut(new.select(*old.columns))
    discard(old)
    return out


def filter_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url: str = "url",
    bad: str = "bad",
    max_children: int = MAX_CHILDREN,
    min_share: float = MIN_SHARE,
    z2: float = Z2,
    strength: float = STRENGTH,
    max_bad: float = MAX_BAD,
) -> DataFrame:
    """(page_id, url, host, template, template_pages, template_labelled, template_bad,
    bad_rate_ppm, rejected), one row per page."""
    p = pages.select(
        F.col(id_col).alias("__id"), F.col(url).alias("__url"), F.col(bad).alias("__bad"), _host(F.col(url)).alias("__host"), _shape(F.col(url)).alias("__shape")
    )
    p = p.withColumn("__shape", F.when(F.col("__host") == "", "").otherwise(F.col("__shape")))
    shapes = cut(
        p.filter("__host <> ''")
        .groupBy("__host", "__shape")
        .agg(F.count(F.lit(1)).alias("n"), F.count("__bad").alias("lab"), F.coalesce(F.sum(F.col("__bad").cast("long")), F.lit(0)).alias("bad"))
    )
    tree = learn(shapes, max_children, min_share, z2)
    corpus = shapes.agg(F.try_divide(F.sum("bad"), F.sum("lab")).alias("__rate"))  # one row; null without labels
    path = F.concat(F.lit("/"), F.array_join("__t", "/"))
    tree = cut(tree.select("__host", "__shape", "n", "lab", "bad", path.alias("template")))
    sums = tree.groupBy("__host", "template").agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "lab", "bad")])
    total, bads = F.col("t_lab"), F.col("t_bad")
    rate = F.try_divide(bads + F.lit(float(strength)) * F.col("__rate"), total + F.lit(float(strength)))
    verdict = cut(
        tree.select("__host", "__shape", "template").join(sums, ["__host", "template"]).crossJoin(F.broadcast(corpus)).select(
            "__host",
            "__shape",
            "template",
            F.col("t_n").alias("template_pages"),
            total.alias("template_labelled"),
            bads.alias("template_bad"),
            F.floor(rate * 1000000 + 0.5).cast("long").alias("bad_rate_ppm"),
            F.coalesce(rate > max_bad, F.lit(False)).alias("rejected"),
        )
    )
    out = p.join(sized(verdict), ["__host", "__shape"], "left")
    return out.select(
        F.col("__id").alias(id_col),
        F.col("__url").alias("url"),
        F.nullif(F.col("__host"), F.lit("")).alias("host"),
        "template",
        "template_pages",
        "template_labelled",
        "template_bad",
        "bad_rate_ppm",
        F.coalesce("rejected", F.lit(False)).alias("rejected"),
    )


def label_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """pages(page_id, url) with ``bad`` from the labels of the document whose number is in the
    path: bad if quality is 0 or toxic is 1 in any of its rows."""
    number = F.regexp_extract(F.regexp_extract("url", _PATH, 1), "([0-9]{1,18})", 1)
    doc = F.when(number != "", number.cast("long"))
    is_bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    one = cut(labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__doc")).agg(F.max(is_bad).alias("bad")))
    p = pages.select("page_id", "url", doc.alias("__doc"))
    return p.join(sized(one), "__doc", "left").select("page_id", "url", "bad")


def sql(pages: str = "pages", labels: str = "labels") -> str:
    """DuckDB SQL at the default parameters, for paths of up to SQL_LEVELS segments."""
    names = [f"t{i}" for i in range(1, SQL_LEVELS + 1)]
    levels = ", ".join(
        [f"coalesce(parts[{i}], '') AS t{i}" for i in range(1, SQL_LEVELS)] + [f"coalesce(array_to_string(parts[{SQL_LEVELS}:], '/'), '') AS t{SQL_LEVELS}"]
    )
    steps = []
    last = "s0"
    keep = "host, shape, n, lab, bad"
    for d in range(1, SQL_LEVELS + 1):
        node = ", ".join(["host", *names[: d - 1]])
        rest = ", ".join(n for n in names if n != f"t{d}")
        steps.append(f"""g{d}a AS (SELECT *, len(list_distinct(list(t{d}) OVER (PARTITION BY {node}))) AS kinds,
  sum(n) OVER (PARTITION BY {node}, t{d}) AS cn, sum(n) OVER (PARTITION BY {node}) AS nn FROM {last}),
g{d} AS (SELECT {keep}, {rest}, CASE WHEN t{d} <> '' AND kinds > {MAX_CHILDREN} AND cn < nn * {MIN_SHARE}::DOUBLE THEN '*' ELSE t{d} END AS t{d} FROM g{d}a)""")
        last = f"g{d}"
    for d in range(SQL_LEVELS, 0, -1):
        rest = ", ".join(n for n in names if n != f"t{d}")
        steps.append(f"""m{d}a AS (SELECT *, (sum(lab) OVER b)::DOUBLE AS bl, (sum(bad) OVER b)::DOUBLE AS bb, (sum(lab) OVER s)::DOUBLE AS sl, (sum(bad) OVER s)::DOUBLE AS sb
  FROM {last} WINDOW b AS (PARTITION BY host, {rest}, t{d}), s AS (PARTITION BY host, {rest}, t{d} = '')),
m{d}b AS (SELECT *, (t{d} <> '' AND bl > 0 AND sl > bl AND (bb * sl - bl * sb) * (bb * sl - bl * sb) * sl <= {Z2}::DOUBLE * bl * (sl - bl) * sb * (sl - sb)) AS alike FROM m{d}a),
m{d}c AS (SELECT *, len(list_distinct(list(CASE WHEN alike THEN t{d} END) OVER (PARTITION BY host, {rest}))) AS likes FROM m{d}b),
m{d} AS (SELECT {keep}, {rest}, CASE WHEN t{d} <> '' AND alike AND likes > 1 THEN '*' ELSE t{d} END AS t{d} FROM m{d}c)""")
        last = f"m{d}"
    chain = ",\n".join(steps)
    return f"""
WITH l AS (SELECT doc_id AS ldoc, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad
  FROM {labels} WHERE doc_id IS NOT NULL GROUP BY doc_id),
u AS (SELECT page_id, url, coalesce(regexp_replace(regexp_replace(lower(regexp_extract(url, '{_HOST}', 1)), '^.*@', ''), ':[0-9]*$', ''), '') AS host,
  regexp_extract(url, '{_PATH}', 1) AS path FROM {pages}),
p AS (SELECT page_id, url, host, bad, CASE WHEN host = '' THEN '' ELSE coalesce(regexp_replace(path, '[0-9]+', '{{n}}', 'g'), '') END AS shape
  FROM u LEFT JOIN l ON TRY_CAST(nullif(regexp_extract(path, '([0-9]{{1,18}})', 1), '') AS BIGINT) = ldoc),
h AS (SELECT host, shape, count(*) AS n, count(bad) AS lab, coalesce(sum(bad), 0) AS bad, list_filter(string_split(shape, '/'), lambda x: x <> '') AS parts
  FROM p WHERE host <> '' GROUP BY host, shape),
s0 AS (SELECT {keep}, {levels} FROM h),
{chain},
c AS (SELECT sum(bad)::DOUBLE / nullif(sum(lab), 0) AS rate FROM h),
v AS (SELECT host, shape, '/' || array_to_string(list_filter([{", ".join(names)}], lambda x: x <> ''), '/') AS template, sum(n) OVER w AS tn, sum(lab) OVER w AS tl, sum(bad) OVER w AS tb,
  ((sum(bad) OVER w)::DOUBLE + {STRENGTH}::DOUBLE * rate) / ((sum(lab) OVER w)::DOUBLE + {STRENGTH}::DOUBLE) AS r FROM {last}, c WINDOW w AS (PARTITION BY host, {", ".join(names)}))
SELECT page_id, url, nullif(p.host, '') AS host, template, tn::BIGINT AS template_pages, tl::BIGINT AS template_labelled, tb::BIGINT AS template_bad,
  CAST(floor(r * 1000000 + 0.5) AS BIGINT) AS bad_rate_ppm, coalesce(r > {MAX_BAD}::DOUBLE, false) AS rejected
FROM p LEFT JOIN v ON p.host = v.host AND p.shape = v.shape"""
