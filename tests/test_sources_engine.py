"""Source trees, manifests, history, and the analysis of a whole directory."""

from __future__ import annotations

import json
import subprocess

import pytest
from pyspark.sql import functions as F
from quarrylight import __main__ as cli
from quarrylight import engine
from quarrylight.operators import deps, graph, history
from quarrylight.sources import gitlog, manifests, tree


def plant(root, files: dict[str, str | bytes]) -> str:
    for path, text in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text) if isinstance(text, bytes) else p.write_text(text)
    return str(root)


def test_walk(spark, tmp_path):
    root = plant(tmp_path, {
        "a.py": "x = 1", "pkg/__init__.py": "", "pkg/_private.js": "é", "node_modules/m/a.js": "no", ".hidden/a.js": "no", "pkg/build/a.js": "no", "k=v/b.go": "package b",
        "img.png": "no", "notes.txt": "no", "bin.js": b"a\0b", "big.js": "x" * 3000, "bad.rb": b"# \xff\xfe", "Dockerfile": "FROM a", "w.min.js": "kept: its ending is .js",
    })
    files, truncated = tree.walk(spark, root, max_bytes=2000)
    got = {r["relative_path"]: r for r in files.collect()}
    assert set(got) == {"a.py", "pkg/__init__.py", "pkg/_private.js", "k=v/b.go", "bad.rb", "Dockerfile", "w.min.js"} and not truncated
    assert got["bad.rb"]["content"] == "# ��" and got["pkg/_private.js"]["size_bytes"] == 2
    few, truncated = tree.walk(spark, root, max_bytes=2000, max_files=3)
    assert truncated and sorted(r["relative_path"] for r in few.collect()) == ["Dockerfile", "a.py", "bad.rb"]
    same, truncated = tree.walk(spark, root, max_bytes=2000, max_files=7)  # the eighth that is listed is not text
    assert same.count() == 7 and not truncated
    assert tree.walk(spark, str(tmp_path / "missing"))[0].count() == 0


def test_workspaces(tmp_path):
    one = plant(tmp_path / "one", {"package.json": '{"dependencies": {"a": "1"}, "devDependencies": {"b": "1"}, "peerDependencies": {"c": "1"}, "optionalDependencies": {"d": "1"}}'})
    got = manifests.workspace(one)
    assert not got.is_monorepo and got.sources[0][1] == {"a", "b", "c", "d"}
    package = {"packages/x/package.json": '{"dependencies": {"in-x": "1"}}', "packages/old/package.json": '{"dependencies": {"in-old": "1"}}', "packages/x/node_modules/y/package.json": "{}", "apps/w/package.json": '{"dependencies": {"in-w": "1"}}'}
    cases = {
        "array": ({"package.json": '{"workspaces": ["packages/*", "!packages/old"]}'}, {"in-x"}),
        "object": ({"package.json": '{"workspaces": {"packages": ["{packages,apps}/*/"]}}'}, {"in-x", "in-old", "in-w"}),
        "pnpm": ({"package.json": "{}", "pnpm-workspace.yaml": "packages: \n  # all\n  - 'packages/x' # one\n  - apps/*\nother:\n  - packages/*\n"}, {"in-x", "in-w"}),
        "lerna": ({"lerna.json": '{"packages": ["apps/*"]}'}, {"in-w"}),
        "turbo": ({"turbo.json": "{}"}, {"in-x", "in-old", "in-w"}),
        "deep": ({"package.json": '{"workspaces": ["**"]}'}, {"in-x", "in-old", "in-w"}),
        "broken": ({"package.json": "{"}, set()),
    }
    for name, (files, want) in cases.items():
        got = manifests.workspace(plant(tmp_path / name, {**package, **files}))
        assert {p for _, names in got.sources for p in names} == want, name
        assert got.is_monorepo == (name != "broken"), name


def test_path_aliases(tmp_path):
    root = plant(tmp_path, {
        "tsconfig.json": '{ // base\n "extends": "./base", "compilerOptions": { "baseUrl": "src", /* c */ }, }',
        "base.json": '{"compilerOptions": {"paths": {"@/*": ["x//y/*"], "~": ["z"]}}}', "tsconfig.build.json": '{"compilerOptions": {"paths": {"no": []}}}',
        "src/lib/a.ts": "", "src/util.tsx": "", "src/readme.md": "", "src/.x/a.ts": "", "app/jsconfig.json": '{"compilerOptions": {"baseUrl": "."}}', "app/main.js": "",
        "loop/tsconfig.json": '{"extends": "./tsconfig.json"}', "bad/tsconfig.json": "{", "pkg/tsconfig.lib.json": '{"compilerOptions": {"paths": {"#x": []}}}', "ext/tsconfig.json": '{"extends": "@tsconfig/base"}',
    })
    got = {d.removeprefix(str(tmp_path.resolve())): (p, n) for d, p, n in manifests.aliases(root)}
    assert got == {"": (["@/*", "~"], ["lib", "util"]), "/app": ([], ["main"]), "/pkg": (["#x"], None)}
    assert manifests.parse_jsonc('{"a": "http://x/*y*/", "b": [1, 2,],}') == {"a": "http://x/*y*/", "b": [1, 2]}


def git(root, *args):
    env = {"GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "A", "GIT_COMMITTER_EMAIL": "a@x", "HOME": str(root), "PATH": "/usr/bin:/bin:/usr/local/bin"}
    subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True, env=env)


def test_history_of_a_repository(spark, tmp_path):
    plant(tmp_path, {"a.py": "1", "dir/b c.py": "1"})
    assert gitlog.touches(spark, str(tmp_path / "nothing")) is None
    git(tmp_path, "init", "-q")
    git(tmp_path, "add", ".")
    git(tmp_path, "commit", "-q", "-m", "one")
    (tmp_path / "a.py").write_text("2")
    git(tmp_path, "commit", "-q", "-a", "-m", "two", "--author", "B <b@x>")
    t = gitlog.touches(spark, str(tmp_path))
    assert sorted((r["author_email"], r["file_path"]) for r in t.collect()) == [("a@x", "a.py"), ("a@x", "dir/b c.py"), ("b@x", "a.py")]
    own = {(r["file_path"], r["email"]): r["percentage"] for r in history.ownership(t).collect()}
    assert own == {("a.py", "a@x"): 50, ("a.py", "b@x"): 50, ("dir/b c.py", "a@x"): 100}
    assert history.high_churn(t).first()["file_path"] == "a.py" and gitlog.touches(spark, str(tmp_path), 1).count() == 1


REPO = {
    "package.json": '{"dependencies": {"express": "1"}}',
    "tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}',
    "src/server.ts": "import express from 'express';\nimport lost from 'lost-package';\nimport { help } from '@/help';\nimport { add } from './util/add';\nexport function start() {\n  add(1);\n  helpMe();\n}\n",
    "src/util/add.ts": "export function add(a) {\n  if (a) { return twice(a); }\n}\nfunction twice(x) {\n  return x;\n}\nfunction unused(y) {\n  return eval(y);\n}\n",
    "src/util/add.test.ts": "import { add } from './add';\nfunction check() {\n  add(2);\n}\n",
    "lib/help.py": "def help_me():\n    return 1\n\ndef _lost():\n    pass\n",
}


def test_analysis_of_a_tree(spark, tmp_path, capsys):
    root = plant(tmp_path / "repo", REPO)
    a = engine.analyze(spark, root)
    assert a.totals.first().asDict() == {"total_files": 4, "total_lines": 30, "total_functions": 7} and not a.is_monorepo and a.history is None
    dead = {(r["name"], r["safe"]) for r in a.dead_code.collect()}
    assert dead == {("start", False), ("unused", True), ("check", False), ("_lost", True)}  # help_me is called from TypeScript as helpMe
    assert [r["package"] for r in a.undeclared.collect()] == ["lost-package"]
    rel = {(r["target"].removeprefix(root), r["dependent"].removeprefix(root)) for r in a.dependencies.collect()}
    assert rel == {("/src/util/add.ts", "/src/server.ts"), ("/src/util/add.ts", "/src/util/add.test.ts")}
    impact = graph.change_impact(a.dependencies, spark.createDataFrame([(f"{root}/src/util/add.ts",)], "seed string")).first()
    assert (impact["direct"], impact["indirect"], impact["total"], impact["risk"]) == (2, 0, 2, "low")
    assert [(r["category"], r["line"]) for r in a.findings.collect()] == [("dynamic-code-execution", 8)]
    assert [r["type"] for r in a.entry_points.collect()] == ["server"]
    assert {(r["source"].split("@")[0], r["target"].split("@")[0]) for r in a.edges.collect()} == {("start", "add"), ("add", "twice"), ("check", "add")}
    doc = json.loads(engine.to_json(a))
    assert doc["health"]["score"] == a.health.first()["score"] and len(doc["nodes"]) == 7 and doc["severities"]["medium"] == 1
    assert engine.dead_listing(a) == ["lib/help.py:4\t_lost", "src/server.ts:5\tstart", "util/add.test.ts:2\tcheck", "util/add.ts:7\tunused"]
    assert "... and 3 more" in engine.report(a, shown=1) and engine.health_line(a).split()[0] == str(doc["health"]["score"])
    engine.save(a, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "functions")).count() == 7
    (tmp_path / "repo/src/util/add.ts").write_text(REPO["src/util/add.ts"].replace("function unused", "function twice_more").replace("return x;", "return twice_more(x);"))
    b = engine.analyze(spark, root)
    diff = engine.compare(a, b).first()
    assert (diff["new_dead"], diff["resolved_dead"]) == (0, 1) and "1 dead function cleaned up." in diff["summary"]
    assert cli.main(["dead-code", root, "--json"], spark) == 0 and len(json.loads(capsys.readouterr().out)) == 3
    a.close()
    b.close()


def test_analysis_of_nothing(spark, tmp_path):
    a = engine.analyze(spark, str(tmp_path))
    assert a.totals.first()["total_files"] == 0 and (a.health.first()["score"], a.health.first()["grade"]) == (85, "A")
    assert a.dead_code.count() == 0 and a.onboarding.count() == 0 and json.loads(engine.to_json(a))["nodes"] == []


def test_hygiene_needs_a_manifest(spark):
    i = spark.createDataFrame([("a.ts", "x"), ("b.ts", "y"), ("a.ts", "y")], "file_path string, source string")
    none = manifests.declared(spark, manifests.Workspace(False))
    assert deps.undeclared_imports(i, none).count() == 0
    empty = manifests.declared(spark, manifests.Workspace(False, [("/r", set())]))
    assert [(r["package"], r["files"]) for r in deps.undeclared_imports(i, empty).collect()] == [("y", 2), ("x", 1)]
    some = manifests.declared(spark, manifests.Workspace(False, [("/r", {"x"}), ("/r/p", {"z"})]))
    assert [r["package"] for r in deps.undeclared_imports(i, some).collect()] == ["y"]


def brute_reach(edges: list[tuple[str, str]], seed: str) -> set[str]:
    seen, todo = {seed}, [seed]
    while todo:
        at = todo.pop()
        for t, d in edges:
            if t == at and d not in seen:
                seen.add(d)
                todo.append(d)
    return seen - {seed}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_change_impact_equals_a_search_from_each_file(spark, seed):
    import random

    r = random.Random(seed)
    nodes = [f"f{i}" for i in range(150)]
    edges = [(r.choice(nodes), r.choice(nodes)) for _ in range(160 if seed < 3 else 500)] + [(f"f{i}", f"f{i + 1}") for i in range(20)]
    df = spark.createDataFrame(edges, "target string, dependent string")
    seeds = spark.createDataFrame([(n,) for n in [*nodes, "alone"]], "seed string")
    got = {x["seed"]: x for x in graph.change_impact(df, seeds).collect()}
    assert set(got) == {*nodes, "alone"}
    for n in got:
        want = brute_reach(edges, n)
        near = {d for t, d in edges if t == n and d != n}
        assert (got[n]["direct"], got[n]["total"], got[n]["indirect"]) == (len(near), len(want), len(want) - len(near))


def test_snapshot_sentences(spark):
    schema = "score int, grade string, dead long, avg_complexity double, functions long"
    p = spark.createDataFrame([(80, "A", 3, 2.5, 10)], schema)
    none = spark.createDataFrame([], "name string, change string")
    assert deps.snapshot_diff(p, p, none).first()["summary"] == "Health score unchanged."
    c = spark.createDataFrame([(70, "B", 4, 2.0, 12)], schema)
    changes = spark.createDataFrame([("a", "new"), ("b", "new"), ("c", "resolved")], "name string, change string")
    s = deps.snapshot_diff(p, c, changes).first()["summary"]
    assert s == "Health score ↓10 (A → B). 2 new dead functions. 1 dead function cleaned up. Avg complexity down 0.5. +2 functions."
    assert deps.snapshot_diff(c, p, changes).first()["score_delta"] == 10


def test_paths_with_the_sign_of_ids(spark):
    """Callers in files whose path has an @ keep their name."""
    fns = spark.createDataFrame([("f", "/r/@scope/a.ts", 0), ("g", "/r/@scope/b.ts", 0)], "name string, file_path string, fn_ord int")
    calls = spark.createDataFrame([("/r/@scope/b.ts", "g@/r/@scope/b.ts", "f")], "file_path string, caller string, callee string")
    out = graph.blast_radius(fns, calls, spark.createDataFrame([("f",)], "seed string")).select("name", "file_path", F.array_join("call_path", ">").alias("way")).collect()
    assert [tuple(r) for r in out] == [("g", "/r/@scope/b.ts", "f>g")]
