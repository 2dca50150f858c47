"""Grammars of languages whose bodies follow from indentation, parentheses, clauses or markers."""

from __future__ import annotations

import re

from .grammar import (
    Calls, Functions, Grammar, Hit, Types, at_margin, dotted, each, file_row, function_row, has, lacks, listed, no_underscore, plain, rx, starts, stem, words,
)
from .source import Source, complexity

_IN = Source.indented
_lower_or_bar = starts("[a-z_]")


def _open_name(h: Hit) -> bool:
    return at_margin(h) and no_underscore(h)


RUBY = Grammar(
    "ruby", "a Ruby file", unit="method", functions_exported=False,
    imports=each(rx(r"""^(?:load|require_relative|require)\s+['"]([^'"]+)['"]"""), plain(relative=dotted)),
    types=(Types(rx(r"^( *)class\s+(\w+)(?:\s*<\s*(\w+))?"), name=2, end=_IN, public=at_margin, extends=3),),
    functions=(Functions(
        rx(r"^( *)def\s+(\w+[?!]?)\s*(?:\(([^)]*)\))?"), name=2, args=3, end=_IN, public=_open_name,
        params=listed(lambda p: re.sub(r"=.*\Z", "", re.sub(r"^[*&]", "", p)).strip()),
    ),),
    calls=Calls((rx(r"\b(\w+)\s*[({]"),), words("begin class def do elsif end for if module p pp puts rescue return unless until while"), _lower_or_bar),
)

CRYSTAL = Grammar(
    "crystal", "a Crystal file", unit="method", functions_exported=False, imports=each(rx(r'^require\s+"([^"]+)"'), plain(relative=dotted)),
    types=(
        Types(rx(r"^( *)class\s+(\w+)(?:\s*<\s*(\w+))?"), name=2, end=_IN, public=at_margin, extends=3),
        Types(rx(r"^( *)module\s+(\w+)"), name=2, end=_IN, public=at_margin),
    ),
    functions=(Functions(
        rx(r"^( *)(private\s+)?def\s+(\w+[?!]?)\s*(?:\(([^)]*)\))?"), name=3, args=4, end=_IN, public=lambda h: _open_name(h) and not h.match[2],
        params=listed(lambda p: re.sub(r"=.*\Z", "", re.split(r"\s*:", re.sub(r"^@", "", p))[0]).strip()),
    ),),
    calls=Calls((rx(r"\b(\w+)\s*[({]"),), words("begin class def do elsif end for if module p puts rescue return unless until while"), _lower_or_bar),
)


def _lua_params(h: Hit, params: list[str], body: str) -> list[str]:
    return ["self", *params] if ":" in h.name else params


LUA = Grammar(
    "lua", "a Lua file", imports=each(rx(r"""\brequire\s*\(?\s*['"]([^'"]+)['"]\s*\)?"""), plain(relative=dotted)),
    functions=(Functions(
        rx(r"^(local\s+)?function\s+([\w.:]+)\s*\(([^)]*)\)"), name=2, args=3, end=_IN, public=lacks(1), params=listed(lambda p: p), from_body=_lua_params
    ),),
    calls=Calls((rx(r"\b([\w.:]+)\s*\("),), words("and break do else elseif end false for function if local nil not or repeat return then true until while")),
)

ELIXIR = Grammar(
    "elixir", "an Elixir file", kind="module", imports=each(rx(r"^\s*(?:alias|import|require|use)\s+([\w.]+)"), plain()),
    types=(Types(rx(r"^( *)defmodule\s+([\w.]+)\s+do\b"), name=2, end=_IN, public=at_margin),),
    functions=(Functions(
        rx(r"^ *def(p)?\s+(\w+[?!]?)\s*(?:\(([^)]*)\))?\s*do\b"), name=2, args=3, end=_IN, public=lacks(1), params=listed(lambda p: p.split("\\\\")[0].strip())
    ),),
    calls=Calls(skip=words("alias case cond def defmacro defmodule defp defstruct do else end fn if import raise require unless use when with")),
)

JULIA = Grammar(
    "julia", "a Julia file", kind="module", named_type=False, imports=each(rx(r"^\s*(?:import|using)\s+([\w.]+)"), plain()),
    types=(Types(rx(r"^( *)module\s+(\w+)"), name=2, end=_IN, public=at_margin),),
    functions=(Functions(
        rx(r"^( *)function\s+(?:[\w!]+\.)*([\w!]+)\s*(?:\(([^)]*)\))?"), name=2, args=3, end=_IN, public=at_margin,
        params=listed(lambda p: re.sub(r"=.*\Z", "", re.split(r"\s*::", p)[0]).strip(), ";"),
    ),),
    calls=Calls((rx(r"\b(\w+!?)\s*\("),), words("begin catch elseif for function if module return try while")),
)


def _nim_imports(src: Source):
    for m in rx(r"^import\s+([\w/, ]+)").finditer(src.text):
        for one in m[1].split(","):
            if one.strip():
                yield one.strip(), [], one.strip().startswith(".")


NIM = Grammar(
    "nim", "a Nim file", unit="procedure", imports=_nim_imports,
    functions=(Functions(
        rx(r"^( *)proc\s+(\w+)(\*)?\s*\(([^)]*)\)"), name=2, args=4, end=_IN, public=lambda h: at_margin(h) and has(3)(h),
        params=listed(lambda p: re.split(r"\s*:", p)[0].strip()),
    ),),
    calls=Calls(skip=words("case elif for func if proc return while")),
)

# -- equations --

_IDENTIFIER = rx(r"\b([a-z_][\w']*)\b")


def _equations(language: str, noun: str, kind: str, module: str, opened: str, reserved: str) -> Grammar:
    skip = words(reserved)
    return Grammar(
        language, noun, kind=kind, named_type=False, imports=each(rx(opened), plain()), types=(Types(rx(module), end=_IN),),
        functions=(Functions(rx(r"^let\s+(?:rec\s+)?(\w+)((?:[ \t]+[^\s=]+)*)[ \t]*=(?!=)"), end=_IN, params=str.split, skip=skip, more_lines=1),),
        calls=Calls((_IDENTIFIER,), skip),
    )


OCAML = _equations(
    "ocaml", "an OCaml file", "module", r"^module\s+(\w+)\s*=\s*struct\b", r"^open\s+(\w+)",
    "and begin else end fun function if in let match module open rec sig struct then type with",
)
FSHARP = _equations("fsharp", "an F# file", "module", r"^module\s+([\w.]+)", r"^open\s+([\w.]+)", "and else fun if in let match module namespace open rec then type with")

_HS_WORDS = words("case class data default deriving do else foreign if import in infix infixl infixr instance let module newtype of then type where")
_HS_EQUATION = rx(r"^([a-z_][\w']*)((?:[ \t]+[^\s=]+)*)[ \t]*=(?!=)")
_HS_TYPES = Grammar(
    "haskell", "a Haskell module", kind="type", named_type=False, imports=each(rx(r"^import\s+(?:qualified\s+)?([\w.]+)"), plain()),
    types=(Types(rx(r"^(?:class|data|newtype)\s+([A-Z]\w*)"), end=_IN),),
    heads=lambda src: [m[1]] if (m := rx(r"^module\s+([\w.]+)").search(src.text)) else [],
)


def haskell(text: str, path: str) -> dict:
    """Consecutive equations of a name are one function, with the first one's parameters."""
    src = Source(text, path)
    groups: list[dict] = []
    for m in _HS_EQUATION.finditer(text):
        if m[1] in _HS_WORDS:
            continue
        first = src.line_at(m.start())
        last = src.indented(first)
        if groups and groups[-1]["name"] == m[1]:
            groups[-1]["last"] = last
            groups[-1]["body"] += "\n" + src.body(first, last)
        else:
            params = [p for p in m[2].split("|")[0].split() if re.match(r"[a-zA-Z_(]", p)]
            groups.append({"name": m[1], "first": first, "last": last, "body": src.body(first, last), "params": params})
    calls = Calls((_IDENTIFIER,), _HS_WORDS)
    functions = [function_row(g["name"], g["first"], g["last"], g["params"], True, calls.find(g["body"], g["name"]), complexity(g["body"])) for g in groups]
    for f in functions:
        f["line_count"] += 1
    base = _HS_TYPES.parse(src)
    return file_row(
        src, "haskell", functions, base["classes"], list(_HS_TYPES.imports(src)), list(dict.fromkeys([*base["exports"], *[f["name"] for f in functions]])),
        explanation=_HS_TYPES._explain(src, base["classes"], functions),
    )


# -- clauses --

_ERL_HEAD = rx(r"^(\w+)\s*\(([^)]*)\)\s*->")
_ERL_STOP = re.compile(r"(?<![0-9])\.(?=[\n \r\t]|\Z)")
_ERL_CALLS = Calls(skip=words("after case catch end fun if of receive try when"), keep=_lower_or_bar)


def erlang(text: str, path: str) -> dict:
    """A function reaches to the full stop that ends its clauses; the search goes on behind it."""
    src = Source(text, path)
    public = {n for m in rx(r"^-export\(\[([^\]]*)\]\)\.").finditer(text) for x in m[1].split(",") if (n := x.strip().split("/")[0].strip())}
    head = rx(r"^-module\((\w+)\)\.").search(text)
    exports, functions, at = [head[1]] if head else [], [], 0
    while m := _ERL_HEAD.search(text, at):
        stop = _ERL_STOP.search(text, m.start())
        end = stop.start() if stop else len(text) - 1
        body = text[m.start() : end + 1]
        params = [w for p in m[2].split(",") if (w := re.split(r"\s+", p.strip())[0])]
        if m[1] in public:
            exports.append(m[1])
        functions.append(function_row(m[1], src.line_at(m.start()), src.line_at(end), params, m[1] in public, _ERL_CALLS.find(body, m[1]), complexity(body)))
        at = end + 1
    imports = [(m[1], [], False) for m in rx(r"^-import\((\w+),").finditer(text)]
    n = len(functions)
    return file_row(src, "erlang", functions, [], imports, list(dict.fromkeys(exports)), explanation=f"{stem(path)} is an Erlang module with {n} function{'' if n == 1 else 's'}.")


# -- lists --


def _clojure_params(h: Hit, params: list[str], body: str) -> list[str]:
    m = re.search(r"\[([^\]]*)\]", body)
    return m[1].split() if m else []


_LISP_HEAD = rx(r"\(([\w!?*+<>=./-]+)")
CLOJURE = Grammar(
    "clojure", "a Clojure file", imports=each(rx(r":require\s+\[?\[([\w.-]+)"), plain()),
    heads=lambda src: [m[1]] if (m := rx(r"\(ns\s+([\w.-]+)").search(src.text)) else [],
    functions=(Functions(rx(r"\((defn-?)\s+([\w!?*+<>=-]+)"), name=2, args=None, end=Source.parens, public=lambda h: h.match[1] == "defn", from_body=_clojure_params),),
    calls=Calls((_LISP_HEAD,), words("cond defn defn- do fn if let loop ns recur when")),
)


def _elisp_params(h: Hit, params: list[str], body: str) -> list[str]:
    m = rx(r"defun\s+[\w!?*+<>=/-]+\s*\(([^)]*)\)").search(body)
    return [p for p in m[1].split() if p not in ("&optional", "&rest")] if m else []


EMACS_LISP = Grammar(
    "elisp", "an Emacs Lisp file", imports=each(rx(r"\(require\s+'([\w-]+)"), plain()),
    functions=(Functions(rx(r"\(defun\s+([\w!?*+<>=/-]+)"), args=None, end=Source.parens, from_body=_elisp_params),),
    calls=Calls((_LISP_HEAD,), words("cond defun if lambda let let* progn setq unless when")),
)

# -- markers --

_ENDFUNCTION = re.compile(r"\s*endfunction\b", re.I)


def _vim_import(m: re.Match):
    s = m[1].strip()
    return (s, [], not s.startswith("$")) if s else None


VIM = Grammar(
    "vimscript", "a Vim script", imports=each(rx(r"^(?:runtime!?|source)\s+([^\r\n]+)"), _vim_import),
    functions=(Functions(
        rx(r"^\s*function!?\s+(s:)?([\w#.]+)\s*\(([^)]*)\)"), name=2, args=3, end=lambda src, i: src.until(i, _ENDFUNCTION), public=lacks(1), params=listed(lambda p: p, "...")
    ),),
    calls=Calls((rx(r"\b(\w+(?:#\w+)*)\s*\("),), words("call elseif for function if return while")),
)

ALL = [RUBY, CRYSTAL, LUA, ELIXIR, JULIA, NIM, OCAML, FSHARP, CLOJURE, EMACS_LISP, VIM]
