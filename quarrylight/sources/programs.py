"""Small programs in several languages, one for each part, whose parsed form is known: the text
has the part's key, and SQL can tell what a parser must find in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: extension, text (K: the key, N: the next one); the SQL side below knows what is in it
_TEXTS: list[tuple[str, str]] = [
    (".ts", "import x from './m'\n\nexport async function run_K(a: number, b = 2) {\n  if (a) { return call_N(b) }\n  else if (b && a) { note('if (x)') } // while\n}\n"),
    (".py", "import os\n\n\ndef run_K(a, *b):\n    for x in b:\n        call_N(x)\n    return '''if\nwhile'''\n\n\ndef _own_K():\n    pass\n"),
    (".go", 'package m\n\nfunc (t *T) Run_K(a int) error {\n  if a > 0 || ok {\n    return call_N(a)\n  }\n  return nil\n}\n'),
    (".java", "import a.b.C;\n\npublic class P_K {\n  public int run_K(int a, String[] b) {\n    while (a > 0) { a = call_N(a); }\n    return a;\n  }\n}\n"),
    (".rb", "require './m'\n\ndef run_K(a, b = 1)\n  call_N(a) if a\n  unless b\n    call_N(b)\n  end\nend\n"),
    ("/Dockerfile", "FROM base_N AS stage_K\nRUN make\n"),
]


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, content) of one program for each row of part."""
    p = ship_package(spark).read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))
    kind = F.col("k") % len(_TEXTS)
    ext = content = F
    for i, (e, t) in enumerate(_TEXTS):
        ext, content = ext.when(kind == i, e), content.when(kind == i, t)
    named = F.replace(F.replace(content, F.lit("_K"), F.concat(F.lit("_"), F.col("k"))), F.lit("_N"), F.concat(F.lit("_"), F.col("k") + 1))
    return p.select(F.concat(F.lit("/src/p"), F.col("k"), ext).alias("file_path"), named.alias("content"))


#: (remainder of the key, extension, name, first line, last line, complexity, exported, parameters, calls) as SQL
_FOUND = [
    (0, ".ts", "'run_' || k", 3, 6, 5, "true", "a|b", "'call_' || (k + 1) || '|note|a|number|b'"),
    (1, ".py", "'run_' || k", 4, 7, 2, "true", "a|b", "'call_' || (k + 1) || '|a|x'"),
    (1, ".py", "'_own_' || k", 11, 13, 1, "false", "", "''"),
    (2, ".go", "'Run_' || k", 3, 8, 3, "true", "a", "'func|call_' || (k + 1)"),
    (3, ".java", "'run_' || k", 4, 7, 2, "true", "a|b", "'call_' || (k + 1)"),
    (3, ".java", "'while'", 5, 5, 2, "false", "0", "'call_' || (k + 1)"),  # a head that looks like a method's
    (4, ".rb", "'run_' || k", 3, 7, 3, "true", "a|b", "'call_' || (k + 1)"),
]


def functions_sql() -> str:
    rows = [
        f"SELECT '/src/p' || k || '{e}' AS file_path, {name} AS name, {a}::INTEGER AS start_line, {b}::INTEGER AS end_line, {c}::INTEGER AS complexity, "
        f"{pub} AS is_exported, '{args}' AS parameters, {calls} AS calls FROM p WHERE k % {len(_TEXTS)} = {r}"
        for r, e, name, a, b, c, pub, args, calls in _FOUND
    ]
    return "WITH p AS (SELECT p_partkey AS k FROM part) " + " UNION ALL ".join(rows)


def summary_sql() -> str:
    """Files, functions, types and imports of each language."""
    per = {0: ("typescript", 1, 0, 1), 1: ("python", 2, 0, 1), 2: ("go", 1, 0, 0), 3: ("java", 2, 1, 1), 4: ("ruby", 1, 0, 1), 5: ("dockerfile", 0, 1, 1)}
    rows = " UNION ALL ".join(
        f"SELECT '{lang}' AS language, count(*) AS files, (count(*) * {f})::BIGINT AS functions, (count(*) * {c})::BIGINT AS classes, (count(*) * {i})::BIGINT AS imports FROM part WHERE p_partkey % {len(_TEXTS)} = {r}"
        for r, (lang, f, c, i) in per.items()
    )
    return f"SELECT * FROM ({rows}) AS x WHERE files > 0"
