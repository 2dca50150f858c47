"""Parsers on small sources, one language at a time, and the scans that they share."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F
from quarrylight.functions import text as tx
from quarrylight.operators import code
from quarrylight.parse import registry
from quarrylight.parse.languages import EXTENSIONS, detect, language_of
from quarrylight.parse.source import Source, complexity, without_noise

#: path, text, functions (name, start, end, parameters, exported, calls), classes (name, extends), imports (source, symbols, relative), exports
CASES = [
    ("a.js", "const { x } = require('fs');\nfunction alone() { return 1; }\nregister(handler);\nfunction handler(a) { x(a); }\n",
     [("alone", 2, 2, [], False, []), ("handler", 4, 4, ["a"], False, ["x", "a"])], [], [("fs", ["x"], False)], []),
    ("b.tsx", "import React, { useState as u } from 'react';\nexport default function Page() {\n  return <Card title='//' />;\n}\nconst Card = async (p) => {\n  if (p) { go(p); }\n};\nexport class Z extends B<C> implements D, E {\n  m() {}\n}\n",
     [("Page", 2, 4, [], True, ["Card"]), ("Card", 5, 7, ["p"], False, ["go", "p"])], [("Z", "B<C> implements D, E")], [("react", ["React", "useState"], False)], ["Page", "Z"]),
    ("m.py", "from .a import (b)\nimport os\n\nclass K(Base):\n    @cached\n    def m(self, x: int = 1, *r):\n        return helper(x)\n\nasync def go():\n    pass\nMAP = {'k': go}\n",
     [("m", 6, 8, ["x", "r"], False, ["helper", "x"]), ("go", 9, 10, [], True, [])], [("K", None)], [(".a", ["(b)"], True), ("os", [], False)], ["K", "go"]),
    ("A.java", "import static a.b.C;\npublic class A extends B {\n  public int f(int[] x, List<String> y) throws E {\n    return g(x);\n  }\n}\n",
     [("f", 3, 5, ["x", "y"], True, ["g"])], [("A", None)], [("a.b.C", ["C"], False)], ["A"]),
    ("m.go", 'import "a/fmt"\ntype S struct {\n}\nfunc (s *S) Do(a int, b string) error {\n  Help(b)\n}\nfunc low() {}\n',
     [("Do", 4, 6, ["a", "b"], True, ["func", "Help"]), ("low", 7, 7, [], False, [])], [("S", None)], [("a/fmt", ["fmt"], False)], ["S", "Do"]),
    ("l.rs", "use crate::a::b;\npub struct P {\n}\npub async fn run<T>(x: &T, self) {\n  step(x);\n}\n",
     [("run", 4, 6, ["x"], True, ["step"])], [("P", None)], [("crate::a::b", ["b"], True)], ["P", "run"]),
    ("c.cpp", '#include <vector>\n#include "u/v.h"\nclass W : public X {\n};\nstatic int f(int *a, char b[]) {\n  MACRO(a); return Go(b);\n}\n',
     [("f", 5, 7, ["a", "b"], True, ["Go"])], [("W", None)], [("vector", ["vector"], False), ("u/v.h", ["v"], True)], ["W"]),
    ("S.cs", "using System.Text;\npublic class S : T {\n  public async Task<int> Run(int a) {\n    return await go(a);\n  }\n}\n",
     [("Run", 3, 5, ["a"], True, ["go"])], [("S", None)], [("System.Text", ["Text"], False)], ["S"]),
    ("r.rb", "require_relative './x'\nclass A < B\n  def go!(a, *b)\n    helper(a)\n  end\nend\ndef top\n  1\nend\n",
     [("go!", 3, 4, ["a", "b"], False, ["helper"]), ("top", 7, 8, [], True, [])], [("A", "B")], [("./x", [], True)], ["A"]),
    ("p.php", "use A\\B as C;\nrequire_once('./d.php');\nclass P extends Q {\n  private function f($a, int $b=2) {\n    g($a);\n  }\n}\n",
     [("f", 4, 6, ["a", "b"], False, ["g"])], [("P", "Q")], [("A\\B", ["C"], False), ("./d.php", [], True)], ["P"]),
    ("k.kt", "import a.b.*\ndata class D(val x: Int) {\n}\nprivate suspend fun f(a: Int) {\n  g(a)\n}\n", [("f", 4, 6, ["a"], False, ["g"])], [("D", None)], [("a.b.", [""], False)], ["D"]),
    ("s.swift", "import UIKit\npublic struct P {\n}\npublic func f(with a: Int) {\n  g(a)\n}\n", [("f", 4, 6, ["a"], True, ["g"])], [("P", None)], [("UIKit", ["UIKit"], False)], ["P", "f"]),
    ("s.scala", "import a.{B}\nobject O {\n  def f(a: Int) = {\n    g(a)\n  }\n}\n", [("f", 3, 5, ["a"], True, ["g"])], [("O", None)], [("a.{B}", ["B"], False)], ["O"]),
    ("d.dart", "import 'package:x/y.dart';\nimport 'z.dart';\nclass _D {\n}\nint f(int a) async {\n  _g(a);\n}\n",
     [("f", 5, 7, ["a"], True, ["_g"])], [("_D", None)], [("package:x/y.dart", [], False), ("z.dart", [], True)], ["f"]),
    ("s.sh", "source ./lib.sh\ngo() {\n  step one && other\n  if check; then echo; fi\n}\n", [("go", 2, 5, [], True, ["step", "other", "check"])], [], [("./lib.sh", [], True)], ["go"]),
    ("l.lua", "local m = require('x.y')\nlocal function f(a)\n  m.g(a)\nend\nfunction T:go(b)\n  f(b)\nend\n",
     [("f", 2, 3, ["a"], False, ["m.g"]), ("T:go", 5, 6, ["self", "b"], True, ["f"])], [], [("x.y", [], False)], ["T:go"]),
    ("p.pl", "package A::B;\nuse strict;\nuse D::E;\nsub _f {\n  my ($x, $y) = @_;\n  g($x);\n}\n", [("_f", 4, 7, ["$x", "$y"], False, ["g"])], [], [("D::E", [], False)], ["A::B"]),
    ("h.hs", "module A where\nimport qualified B.C as D\ndata T = U\nf 0 = 1\nf n = g n\nh x = f x\n",
     [("f", 4, 5, [], True, ["n", "g"]), ("h", 6, 7, ["x"], True, ["x", "f"])], [("T", None)], [("B.C", [], False)], ["A", "T", "f", "h"]),
    ("e.ex", "defmodule A.B do\n  alias C.D\n  def f(a, b \\\\ 1) do\n    g(a)\n  end\n  defp p(x) do\n    x\n  end\nend\n",
     [("f", 3, 4, ["a", "b"], True, ["g"]), ("p", 6, 7, ["x"], False, [])], [("A.B", None)], [("C.D", [], False)], ["A.B", "f"]),
    ("o.m", '#import "A.h"\n#import <B/B.h>\n@interface A : NSObject\n- (void)decl;\n@end\n@implementation A\n- (int)go:(int)a with:(id)b {\n  [self help:a];\n}\n@end\n',
     [("go", 7, 9, ["a", "b"], True, ["help"])], [("A", "NSObject"), ("A", None)], [("A.h", [], True), ("B/B.h", [], False)], ["A", "go"]),
    ("z.zig", 'const s = @import("std");\npub const P = struct {\n};\nfn f(a: u8) void {\n  g(a);\n}\n', [("f", 4, 6, ["a"], False, ["g"])], [("P", None)], [("std", [], False)], ["P"]),
    ("s.sol", 'import "./a.sol";\ncontract C is D {\n  function f(uint a) internal {\n    g(a);\n  }\n}\n', [("f", 3, 5, ["a"], False, ["g"])], [("C", None)], [("./a.sol", [], True)], ["C"]),
    ("p.ps1", "Import-Module Foo\n. ./x.ps1\nclass K : L {\n}\nfunction Get-It {\n  param([int]$A, $B = 1)\n  Do-That $A\n}\n",
     [("Get-It", 5, 8, ["A", "B"], True, ["B", "Do-That", "A"])], [("K", "L")], [("Foo", [], False), ("./x.ps1", [], True)], ["K", "Get-It"]),
    ("b.gradle", "import a.B\nclass C extends D {\n  private def f(String a) {\n    g(a)\n  }\n}\n", [("f", 3, 5, ["a"], False, ["g"])], [("C", "D")], [("a.B", [], False)], ["C"]),
    ("o.ml", "open Base\nmodule M = struct\n  let x = 1\nend\nlet rec f a b =\n  g a\n", [("f", 5, 7, ["a", "b"], True, ["a", "b", "g"])], [("M", None)], [("Base", [], False)], ["M", "f"]),
    ("f.fs", "module A.B\nopen C.D\nlet f a =\n  g a\n", [("f", 3, 5, ["a"], True, ["a", "g"])], [("A.B", None)], [("C.D", [], False)], ["A.B", "f"]),
    ("e.erl", "-module(m).\n-export([f/1]).\n-import(lists, [x/1]).\nf(0) -> 1.5;\nf(X) ->\n  g(X).\ng(Y) -> Y.\n",
     [("f", 4, 6, ["0"], True, ["g"]), ("g", 7, 7, ["Y"], False, [])], [], [("lists", [], False)], ["m", "f"]),
    ("c.clj", "(ns a.b (:require [c.d :as e]))\n(defn f [x y]\n  (g x))\n(defn- p [] 1)\n", [("f", 2, 3, ["x", "y"], True, ["g"]), ("p", 4, 4, [], False, [])], [], [("c.d", [], False)], ["a.b", "f"]),
    ("e.el", "(require 'cl)\n(defun f (a &optional b)\n  (g a))\n", [("f", 2, 3, ["a", "b"], True, ["a", "g"])], [], [("cl", [], False)], ["f"]),
    ("j.jl", "using A.B\nmodule M\n  function f!(x::Int, y=1)\n    g!(x)\n  end\nend\nfunction B.h(a)\n  1\nend\n",
     [("f!", 3, 4, ["x", "y"], False, ["g!"]), ("h", 7, 8, ["a"], True, [])], [("M", None)], [("A.B", [], False)], ["M", "h"]),
    ("n.nim", "import a, b/c\nproc f*(x: int) =\n  g(x)\nproc h() =\n  1\n", [("f", 2, 3, ["x"], True, ["g"]), ("h", 4, 6, [], False, [])], [], [("a", [], False), ("b/c", [], False)], ["f"]),
    ("c.cr", 'require "./a"\nclass A < B\nend\nmodule M\nend\nprivate def f(@a : Int, b = 1)\n  g(a)\nend\n', [("f", 6, 7, ["a", "b"], False, ["g"])], [("A", "B"), ("M", None)], [("./a", [], True)], ["A", "M"]),
    ("v.vim", "source $X/a.vim\nruntime b.vim\nfunction! s:f(a, ...)\n  call g#h(a)\nendfunction\n", [("f", 3, 5, ["a"], False, ["g#h"])], [], [("$X/a.vim", [], False), ("b.vim", [], True)], []),
    ("Makefile", "include x.mk\n.PHONY: all\nall: dep b\n\t$(MAKE) other\nV := 1\n", [("all", 3, 4, ["dep", "b"], True, ["dep", "b", "other"])], [], [("x.mk", [], True)], ["all"]),
    ("Dockerfile.dev", "FROM node:20 AS build\nRUN x\nFROM build\nCOPY --from=build /a /b\n", [], [("build", "node:20"), ("stage-1", "build")],
     [("node:20", [], False), ("build", [], True), ("build", [], True)], ["build", "stage-1"]),
    ("t.tf", 'module "m" {\n  source = "./x"\n}\nresource "aws_x" "y" {\n}\n', [], [("m", "module"), ("aws_x.y", "resource")], [("./x", [], True)], ["m", "aws_x.y"]),
    ("q.sql", "CREATE TABLE IF NOT EXISTS t (\n a int\n);\nCREATE OR REPLACE FUNCTION f(a int) RETURNS int AS $$\nBEGIN\n  RETURN G(a);\nEND;\n$$;\n",
     [("f", 4, 7, ["a"], True, ["G"])], [("t", None)], [], ["t", "f"]),
    ("c.vue", "<template/>\n<script lang=\"ts\">\nimport a from './a';\nfunction f() { a(); }\n</script>\n", [("f", 4, 4, [], False, ["a"])], [], [("./a", ["a"], True)], []),
    ("c.svelte", "<p/>\n", [], [], [], []),
    ("p.proto", 'import "a/b.proto";\nmessage M {\n}\nservice S {\n  rpc Go (stream M) returns (M);\n}\n', [("Go", 5, 5, ["M"], True, [])], [("M", "message"), ("S", "service")], [("a/b.proto", [], False)], ["M", "S", "Go"]),
    ("s.graphql", "type Q implements N {\n  user(id: ID!, n: Int): User\n  plain: Int\n}\nenum E {\n}\n", [("user", 2, 2, ["id", "n"], True, [])], [("Q", "type"), ("E", "enum")], [], ["Q", "user", "E"]),
    ("b.bat", "call other.bat\n:start\ncall :done\ngoto :eof\n:done\necho x\n", [("start", 2, 4, [], True, ["done"]), ("done", 5, 7, [], True, [])], [], [("other.bat", [], True)], ["start", "done"]),
    ("y.yaml", "a: 1\nb: 2", [], [], [], []),
]


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_each_language(case):
    path, text, functions, classes, imports, exports = case
    r = registry.parse_text(text, "/x/" + path)
    assert [(f["name"], f["start_line"], f["end_line"], f["parameters"], f["is_exported"], f["calls"]) for f in r["functions"]] == functions
    assert [(c["name"], c["extends"]) for c in r["classes"]] == classes
    assert [(i["source"], i["symbols"], i["is_relative"]) for i in r["imports"]] == imports
    assert r["exports"] == exports
    assert r["line_count"] == text.count("\n") + 1 and r["language"] == detect(path)
    if not functions:
        assert r["complexity"] == 1


def test_every_detected_language_is_parsed_or_counted():
    from quarrylight.parse.languages import LINES_ONLY

    assert set(EXTENSIONS.values()) | {"dockerfile"} == set(registry.PARSERS) | set(LINES_ONLY)


def test_references_that_keep_functions_alive():
    js = registry.parse_text("a.b = function () { used(); }\nx = cond ? first : second;\nreturn third;\nnew Fourth();\nfifth.method();\nfunction declared() {}\n", "/x/a.js")
    assert {"used", "first", "second", "third", "Fourth", "fifth"} <= set(js["module_level_calls"]) and "declared" not in js["module_level_calls"]
    py = registry.parse_text("def run(): pass\n\nif __name__ == '__main__':\n    run()\nT = [other]\n@deco\ndef g(): pass\n", "/x/a.py")
    assert {"run", "other", "deco"} <= set(py["module_level_calls"]) and "g" not in py["module_level_calls"]
    common = registry.parse_text("function a() {}\nfunction b() {}\nfunction c() {}\nmodule.exports = { a };\nexports.b = b;\n", "/x/a.js")
    assert [f["is_exported"] for f in common["functions"]] == [True, True, False]


def test_noise_and_complexity_agree_in_python_and_spark(spark):
    texts = [
        "", "if (a) { // if\n} else if (b) {}", "x = 'it\\'s' # for\n", '"""doc if\n""" while', "/* if */ a ? b : c ?? d", "`${x} if` && y || z => w", "'open if", "a\\", '"ends with \\',
        "'" * 7, '""', "''''''", "case x: do { } while (1)", "#!", "// only", "/*", "\"" + "x" * 1_000_000 + "\" if", "`" + "\\n" * 300_000, "é if ñ and", "elif elsif unless for foreach until switch catch except rescue select or",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", tx.strip_strings_and_comments(F.col("t")).alias("bare"), tx.cyclomatic_complexity(F.col("t")).alias("c")).collect()
    for r in got:
        assert r["bare"] == without_noise(texts[r["i"]]) and r["c"] == complexity(texts[r["i"]])
    assert [complexity(t) for t in texts[:6]] == [1, 4, 1, 2, 3, 4]


def brute_block(lines: list[str], first: int, pair: str = "{}") -> int:
    depth, begun = 0, False
    for i in range(first, len(lines)):
        for ch in lines[i]:
            begun |= ch == pair[0]
            depth += (ch == pair[0]) - (ch == pair[1])
        if begun and depth == 0:
            return i
    return first


def test_blocks_equal_a_plain_scan():
    import random

    r = random.Random(0)
    for _ in range(200):
        text = "".join(r.choice(["{", "}", "(", ")", "x", "\n", "\n", "  "]) for _ in range(r.randint(0, 60)))
        src = Source(text)
        for i in range(len(src.lines)):
            assert src.balanced(i) == brute_block(src.lines, i)
            assert src.parens(i) == brute_block(src.lines, i, "()")
        for at in range(len(text)):
            assert src.line_at(at) == text.count("\n", 0, at)
    assert Source("a\n  b\n\nc").indented(0) == 2 and Source("a\n\n").indented(0) == 2 and Source("  a\n b").indented(0) == 0


def test_languages_by_name_agree(spark):
    names = ["Makefile", "x/GNUmakefile", "Dockerfile", "dockerfile.prod", "makefile.am", "a.TS", "a.b.py", ".py", "noext", "x.lhs", "A.M", "dir.js/file", "C:\\x\\y.rs", "m.mk", "x.unknown", "a.min.js"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r[0] for r in df.select(language_of(F.col("p"))).collect()] == [detect(n) for n in names]
    assert [detect(n) for n in names[:9]] == ["makefile", "makefile", "dockerfile", "dockerfile", "makefile", "typescript", "python", "unknown", "unknown"]


def test_parsed_table_and_registered_parsers(spark):
    def upper(text, path):
        from quarrylight.parse.grammar import file_row, function_row

        src = Source(text, path)
        return file_row(src, "shout", [function_row(m[0], 0, 0, [], True, [], 1) for m in re.finditer("[A-Z]+", text)], [], [], [])

    rows = [(p, t) for p, t, *_ in CASES] + [("bad.shout", "ABC d EF"), ("none.py", None), (None, "x"), ("big.py", "def f(): pass\n" * 20_000), ("a.py", "def lonely(): f()\n")]
    registry.register_parser("shout", upper, (".shout",))
    try:
        parsed = registry.parse_files(spark.createDataFrame(rows, "file_path string, content string"))
        got = {r["file_path"]: r for r in parsed.collect()}
    finally:
        del registry.PARSERS["shout"], EXTENSIONS[".shout"]
    assert len(got) == len(rows) and [f["name"] for f in got["bad.shout"]["functions"]] == ["ABC", "EF"]
    assert got["none.py"]["line_count"] == 1 and got[None]["language"] == "unknown" and len(got["big.py"]["functions"]) == 20_000
    fns, calls = registry.functions_of(parsed), registry.calls_of(parsed)
    dead = {(r["file_path"], r["name"]) for r in code.dead_code(fns, calls).collect()}
    assert ("a.js", "alone") in dead and ("a.js", "handler") not in dead and ("a.py", "lonely") in dead and ("big.py", "f") not in dead
    assert registry.imports_of(parsed).count() == sum(len(c[4]) for c in CASES) and registry.classes_of(parsed).filter("file_path = 'p.proto'").count() == 2
    assert registry.parse_files(spark.createDataFrame([], "file_path string, content string")).count() == 0


def test_a_failing_parser_leaves_the_file_with_its_lines():
    def broken(text, path):
        raise ValueError

    r = registry.parse_text("a\nb", "/x/a.py", parsers={"python": broken})
    assert r["language"] == "python" and r["line_count"] == 2 and r["functions"] == [] and r["complexity"] == 1
