"""Declarative grammars: what a function, a type and an import look like, and one engine for all.

Patterns use ASCII classes, and ``^`` at every line. A definition belongs to the line where
its match begins, which for patterns that begin with white space may be a blank line above.
"""

from __future__ import annotations

import math
import posixpath
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from .source import Source, complexity

Import = tuple[str, list[str], bool]


def rx(pattern: str, flags: int = 0) -> re.Pattern:
    return re.compile(pattern, re.M | re.A | flags)


def words(text: str) -> frozenset[str]:
    return frozenset(text.split())


def some_of(text: str) -> str:
    """Any number of the given words, each followed by white space."""
    return rf"(?:(?:{'|'.join(text.split())})\s+)*"


def stem(path: str) -> str:
    base = posixpath.basename(path)
    return posixpath.splitext(base)[0]


@dataclass
class Hit:
    """A definition that was found."""

    match: re.Match
    src: Source
    name: str

    def near(self, before: int, after: int) -> str:
        at = self.match.start()
        return self.src.text[max(0, at - before) : at + after]

    def group(self, n: int) -> str:
        return self.match[n] or ""


def always(_: Hit) -> bool:
    return True


def never(_: Hit) -> bool:
    return False


def says(word: str, before: int, after: int) -> Callable[[Hit], bool]:
    return lambda h: word in h.near(before, after)


def silent(word: str, before: int, after: int) -> Callable[[Hit], bool]:
    return lambda h: word not in h.near(before, after)


def has(n: int) -> Callable[[Hit], bool]:
    return lambda h: bool(h.match[n])


def lacks(n: int) -> Callable[[Hit], bool]:
    return lambda h: not h.match[n]


def at_margin(h: Hit) -> bool:
    return not h.match[1]


def no_underscore(h: Hit) -> bool:
    return not h.name.startswith("_")


def capital(h: Hit) -> bool:
    return "A" <= h.name[0] <= "Z"


@dataclass(frozen=True)
class Calls:
    """Names that a body refers to: first groups of the patterns, less ``skip``, the function's
    own name and what ``keep`` rejects."""

    patterns: tuple[re.Pattern, ...] = (rx(r"\b(\w+)\s*\("),)
    skip: frozenset[str] = frozenset()
    keep: Callable[[str], bool] | None = None
    fold: bool = False

    def find(self, body: str, own: str) -> list[str]:
        low = str.lower if self.fold else str
        found: dict[str, None] = {}
        for p in self.patterns:
            for m in p.finditer(body):
                n = m[1]
                if n and low(n) not in self.skip and low(n) != low(own) and (self.keep is None or self.keep(n)):
                    found[n] = None
        return list(found)


def starts(pattern: str) -> Callable[[str], bool]:
    return lambda n, p=re.compile(pattern): bool(p.match(n))


@dataclass(frozen=True)
class Functions:
    pattern: re.Pattern
    name: int = 1
    args: int | None = 2
    params: Callable[[str], list[str]] = lambda raw: []
    end: Callable[[Source, int], int] = Source.balanced
    public: Callable[[Hit], bool] = always
    is_async: Callable[[Hit], bool] = never
    skip: frozenset[str] = frozenset()
    only: Callable[[Hit], bool] = always
    more_lines: int = 0  # what is counted beside the lines of the body
    #: parameters from (hit, body), where the head does not tell
    from_body: Callable[[Hit, list[str], str], list[str]] | None = None


@dataclass(frozen=True)
class Types:
    pattern: re.Pattern
    name: int = 1
    end: Callable[[Source, int], int] = Source.balanced
    public: Callable[[Hit], bool] = always
    extends: int | None = None
    listed: Callable[[Hit], bool] | None = None  # in exports, if not as ``public`` says


@dataclass(frozen=True)
class Grammar:
    language: str
    noun: str
    functions: tuple[Functions, ...] = ()
    types: tuple[Types, ...] = ()
    imports: Callable[[Source], Iterable[Import]] = lambda src: ()
    calls: Calls = Calls()
    unit: str = "function"
    kind: str = "class"
    #: how types are described: the first by name, or their number
    named_type: bool = True
    #: names exported beside types and functions, first
    heads: Callable[[Source], Iterable[str]] = lambda src: ()
    functions_exported: bool = True
    types_exported: bool = True
    repeats: bool = False

    def parse(self, src: Source) -> dict:
        exports = list(self.heads(src))
        types, functions = [], []
        for rule in self.types:
            for m in rule.pattern.finditer(src.text):
                if not m[rule.name]:
                    continue
                hit = Hit(m, src, m[rule.name])
                first = src.line_at(m.start())
                public = rule.public(hit)
                types.append(class_row(hit.name, first, rule.end(src, first), (m[rule.extends] if rule.extends else None) or None, [], public))
                if self.types_exported and (rule.listed(hit) if rule.listed else public):
                    exports.append(hit.name)
        for rule in self.functions:
            for m in rule.pattern.finditer(src.text):
                if not m[rule.name] or m[rule.name] in rule.skip:
                    continue
                hit = Hit(m, src, m[rule.name])
                if not rule.only(hit):
                    continue
                first = src.line_at(m.start())
                last = rule.end(src, first)
                body = src.body(first, last)
                params = rule.params(hit.group(rule.args)) if rule.args else []
                if rule.from_body:
                    params = rule.from_body(hit, params, body)
                public = rule.public(hit)
                row = function_row(hit.name, first, last, params, public, self.calls.find(body, hit.name), complexity(body), rule.is_async(hit))
                row["line_count"] += rule.more_lines
                functions.append(row)
                if public and self.functions_exported:
                    exports.append(hit.name)
        if not self.repeats:
            exports = list(dict.fromkeys(exports))
        return file_row(src, self.language, functions, types, list(self.imports(src)), exports, explanation=self._explain(src, types, functions))

    def _explain(self, src: Source, types: list[dict], functions: list[dict]) -> str:
        n = len(functions)
        fns = f"{n} {self.unit}{'' if n == 1 else 's'}"
        if types and self.named_type:
            return f"{stem(src.path)} defines the {types[0]['name']} {self.kind} with {fns}."
        if types:
            plural = "" if len(types) == 1 else "es" if self.kind.endswith("s") else "s"
            return f"{stem(src.path)} defines {len(types)} {self.kind}{plural} and {fns}."
        return f"{stem(src.path)} is {self.noun} with {fns}."


def function_row(name: str, first: int, last: int, params: list[str], public: bool, calls: list[str], score: int, is_async: bool = False, default: bool | None = None) -> dict:
    return {
        "name": name, "start_line": first + 1, "end_line": last + 1, "parameters": params, "is_exported": public, "is_default_export": default,
        "is_async": is_async, "calls": calls, "complexity": score, "line_count": last - first + 1,
    }


def class_row(name: str, first: int, last: int, extends: str | None, implements: list[str], public: bool) -> dict:
    return {"name": name, "start_line": first + 1, "end_line": last + 1, "extends": extends, "implements": implements, "is_exported": public}


def mean_complexity(functions: list[dict]) -> float:
    """Average to two places, halves up; one without functions."""
    if not functions:
        return 1.0
    return math.floor(sum(f["complexity"] for f in functions) / len(functions) * 100 + 0.5) / 100


def file_row(
    src: Source, language: str, functions: list[dict], classes: list[dict], imports: list[Import], exports: list[str],
    module_level_calls: list[str] | None = None, explanation: str = "", score: float | None = None,
) -> dict:
    return {
        "language": language, "line_count": len(src.lines), "complexity": mean_complexity(functions) if score is None else score, "explanation": explanation,
        "exports": exports, "module_level_calls": module_level_calls, "functions": functions, "classes": classes,
        "imports": [{"source": s, "symbols": list(y), "is_relative": r} for s, y, r in imports],
    }


# -- pieces of parameter lists --


def items(cut: Callable[[str], str], raw: str, without: Iterable[str] = ()) -> list[str]:
    found = (cut(p.strip()) for p in raw.split(","))
    return [p for p in found if p and p not in without]


def listed(cut: Callable[[str], str], without: str = "") -> Callable[[str], list[str]]:
    return lambda raw: items(cut, raw, without.split())


def last_word(p: str) -> str:
    return re.split(r"\s+", p)[-1]


def first_word(p: str) -> str:
    return re.split(r"\s+", p)[0]


def before_colon(p: str) -> str:
    return p.split(":")[0].strip()


def drop(pattern: str, then: Callable[[str], str] = str.strip) -> Callable[[str], str]:
    return lambda p: then(re.sub(pattern, "", p))


def each(pattern: re.Pattern, row: Callable[[re.Match], Import | None]) -> Callable[[Source], Iterator[Import]]:
    """Imports from every match of a pattern."""

    def find(src: Source) -> Iterator[Import]:
        for m in pattern.finditer(src.text):
            got = row(m)
            if got is not None:
                yield got

    return find


def both(*parts: Callable[[Source], Iterable[Import]]) -> Callable[[Source], Iterator[Import]]:
    def find(src: Source) -> Iterator[Import]:
        for p in parts:
            yield from p(src)

    return find


def plain(n: int = 1, relative: Callable[[str], bool] = lambda s: False) -> Callable[[re.Match], Import | None]:
    return lambda m: (m[n] or "", [], relative(m[n] or ""))


def dotted(s: str) -> bool:
    return s.startswith(".")


def tail(sep: str, n: int = 1, strip: str = "") -> Callable[[re.Match], Import | None]:
    """The last part of the source is its symbol."""
    return lambda m: (m[n], [m[n].split(sep)[-1].translate({ord(c): None for c in strip})], False)
