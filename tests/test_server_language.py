"""A server file whose functions are of several languages has one language, however rows come in."""

from __future__ import annotations

from quarrylight.operators import code


def test_the_first_serving_function_tells_the_language(spark):
    rows = [("GET", "/a/server.ts", lang, i) for i, lang in [(9, "go"), (5, "python"), (2, "zig"), (7, "cpp")]]
    rows += [("use", "/b/app.js", "python", 4), ("use", "/b/app.js", "go", 4), ("other", "/b/app.js", "ada", 1)]
    names = "name string, file_path string, language string, fn_ord int"
    for some in (rows, rows[::-1], sorted(rows, key=lambda r: r[2])):
        f = spark.createDataFrame(some, names).selectExpr("*", "1 AS start_line", "false AS is_default_export").repartition(3, "language")
        got = {r["file_path"]: r["language"] for r in code.entry_points(f).filter("description like '%HTTP server%'").collect()}
        assert got == {"/a/server.ts": "zig", "/b/app.js": "go"}
