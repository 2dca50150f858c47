"""Grammars of languages whose bodies are in braces."""

from __future__ import annotations

import posixpath
import re

from .grammar import (
    Calls, Functions, Grammar, Hit, Types, before_colon, both, capital, dotted, each, first_word, has, last_word, listed, no_underscore, plain,
    rx, says, silent, some_of, starts, tail, words,
)
from .source import Source

_lower, _lower_or_bar = starts("[a-z]"), starts("[a-z_]")

JAVA = Grammar(
    "java", "a Java file", unit="method",
    imports=each(rx(r"^import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;"), tail(".")),
    types=(Types(
        rx(rf"^\s*{some_of('abstract final private protected public static')}(?:class|enum|interface|record)\s+(\w+)(?:\s+extends\s+[\w<>., ]+)?(?:\s+implements\s+[\w<>., ]+)?\s*\{{"),
        public=lambda h: "public" in h.near(2, len(h.name) + 20),
    ),),
    functions=(Functions(
        rx(rf"^\s*{some_of('abstract default final native private protected public static strictfp synchronized')}(?:<[^>]+>\s+)?[\w$\[\]<>.,? ]+\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w,\s.]+)?\s*\{{"),
        params=listed(lambda p: re.sub(r"[\[\]]", "", last_word(p))), public=says("public", 5, 30),
    ),),
    calls=Calls(skip=words("catch for if new return switch throw while"), keep=_lower), functions_exported=False, repeats=True,
)


def _go_imports(src: Source):
    line = rx(r'^\s+(?:(\w+)\s+)?"([^"]+)"')
    for block in re.finditer(r"import\s+\(([^)]+)\)", src.text):
        for m in line.finditer(block[1]):
            yield m[2], [m[1] or m[2].split("/")[-1]], m[2].startswith(".")
    for m in rx(r'^import\s+"([^"]+)"').finditer(src.text):
        yield m[1], [m[1].split("/")[-1]], False


GO = Grammar(
    "go", "a Go file", named_type=False, kind="struct", imports=_go_imports,
    types=(Types(rx(r"^type\s+(\w+)\s+struct\s*\{"), public=capital),),
    functions=(Functions(rx(r"^func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(([^)]*)\)"), params=listed(first_word), public=capital),),
    calls=Calls(skip=words("append cap copy defer for go if len make new return select switch")),
)


def _rust_param(p: str) -> str:
    return re.sub(r"^&(?:mut\s+)?", "", (p[: p.index(":")] if p.find(":") > 0 else p).strip())


def _rust_import(m: re.Match):
    return m[1], [m[1].split("::")[-1]], m[1].startswith(("crate", "super", "self"))


RUST = Grammar(
    "rust", "a Rust module", named_type=False, kind="struct", imports=each(rx(r"^use\s+([\w:{}*, ]+);"), _rust_import),
    types=(Types(rx(r"^(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), public=says("pub", 5, 5)),),
    functions=(Functions(
        rx(r"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)(?:<[^>]*>)?\s*\(([^)]*)\)"),
        params=listed(_rust_param, "self &self"), public=says("pub", 5, 30), is_async=says("async", 5, 30),
    ),),
    calls=Calls((rx(r"\b(\w+)\s*(?:::\s*\w+\s*)?\("),), words("eprintln for if let loop match panic println return vec while"), _lower),
)


def _include(m: re.Match):
    near = m.string[m.start() : m.start() + len(m[1]) + 15]
    return m[1], [posixpath.splitext(posixpath.basename(m[1]))[0]], "<" not in near


_MACRO = re.compile(r"[A-Z_][A-Z0-9_]*\Z")


def c_like(language: str, title: str) -> Grammar:
    return Grammar(
        language, f"a {title} file", named_type=False, imports=each(rx(r'^#include\s+[<"]([^>"]+)[>"]'), _include),
        types=(Types(rx(r"^(?:class|struct)\s+(\w+)(?:\s*:\s*(?:public|private|protected)?\s*[\w:, ]+)?\s*\{")),),
        functions=(Functions(
            rx(r"^(?![ \t]*(?:\#|else|for|if|switch|while))[ \t]*[\w*&:<>~\s]+?\s+(\w+)\s*\(([^;{]*)\)\s*(?:const\s*)?(?:noexcept[^;{]*)?\s*\{"),
            params=listed(lambda p: re.sub(r"[*&\[\]]", "", last_word(p))), public=silent("static", 15, 0),
            skip=words("class do else for if namespace return struct switch while"),
        ),),
        calls=Calls(skip=words("delete for if new return sizeof switch typeof while"), keep=lambda n: not _MACRO.match(n)), functions_exported=False, repeats=True,
    )


CSHARP = Grammar(
    "csharp", "a C# file", unit="method", imports=each(rx(r"^using\s+(?:static\s+)?([\w.]+);"), tail(".")),
    types=(Types(
        rx(rf"^\s*{some_of('abstract internal partial private protected public sealed static')}(?:class|enum|interface|record|struct)\s+(\w+)(?:\s*:\s*[\w<>.,\s]+)?\s*(?:where[^{{]*)?\s*\{{"),
        public=lambda h: "public" in h.near(5, len(h.name) + 20),
    ),),
    functions=(Functions(
        rx(rf"^\s*{some_of('abstract async extern internal new override partial private protected public sealed static virtual')}(?:[\w<>\[\]?]+\s+)+(\w+)\s*\(([^)]*)\)\s*(?:where[^{{]*)?\s*\{{"),
        params=listed(last_word), public=says("public", 5, 50), is_async=says("async", 5, 50),
        skip=words("await catch for foreach if new return switch using while"),
    ),),
    calls=Calls(skip=words("catch for foreach if nameof new return switch typeof while"), keep=_lower), functions_exported=False, repeats=True,
)


PHP = Grammar(
    "php", "a PHP file", unit="method",
    imports=both(
        each(rx(r"^use\s+([\w\\]+)(?:\s+as\s+(\w+))?;"), lambda m: (m[1], [m[2] or m[1].split("\\")[-1]], False)),
        each(rx(r"""^(?:include|require)(?:_once)?\s*\(?['"]([^'"]+)['"]\)?"""), plain(relative=lambda s: s.startswith((".", "/")))),
    ),
    types=(Types(rx(rf"^\s*{some_of('abstract final')}class\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+[\w,\s]+)?\s*\{{"), extends=2),),
    functions=(Functions(
        rx(rf"^\s*{some_of('abstract final private protected public static')}function\s+(\w+)\s*\(([^)]*)\)"),
        params=listed(lambda p: last_word(re.sub(r"=.*\Z", "", p.replace("$", "", 1)))),
        public=lambda h: "public" in h.near(5, 20) or "private" not in h.near(5, 20),
    ),),
    calls=Calls(skip=words("catch echo elseif for foreach function if print return switch while"), keep=_lower_or_bar), functions_exported=False, repeats=True,
)

KOTLIN = Grammar(
    "kotlin", "a Kotlin file", named_type=False, imports=each(rx(r"^import\s+([\w.]+(?:\.\*)?)"), tail(".")),
    types=(Types(
        rx(rf"^\s*{some_of('abstract companion data enum inner internal open private protected public sealed value')}(?:class|interface|object)\s+(\w+)"), public=silent("private", 5, 0)
    ),),
    functions=(Functions(
        rx(rf"^\s*{some_of('abstract external final infix inline internal open operator override private protected public suspend tailrec')}fun\s+(?:<[^>]*>\s+)?(\w+)\s*\(([^)]*)\)"),
        params=listed(before_colon), public=silent("private", 5, 40), is_async=says("suspend", 5, 40),
    ),),
    calls=Calls(skip=words("catch for if return throw when while"), keep=_lower),
)

_SWIFT_ACCESS = "class convenience fileprivate final internal lazy mutating nonmutating open override private public required static weak"
SWIFT = Grammar(
    "swift", "a Swift file", named_type=False, imports=each(rx(r"^import\s+(\w[\w.]*)"), lambda m: (m[1], [m[1]], False)),
    types=(Types(rx(rf"^\s*{some_of('final internal open private public')}(?:actor|class|enum|protocol|struct)\s+(\w+)"), public=says("public", 5, 20)),),
    functions=(Functions(
        rx(rf"^\s*{some_of(_SWIFT_ACCESS)}(?:async\s+)?func\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)"),
        params=listed(lambda p: last_word(p.split(":")[0]).strip()), public=lambda h: "public" in h.near(5, 40) or "open" in h.near(5, 40), is_async=says("async", 5, 40),
    ),),
    calls=Calls(skip=words("catch for guard if return switch throw while"), keep=_lower),
)

SCALA = Grammar(
    "scala", "a Scala file", named_type=False, imports=each(rx(r"^import\s+([\w.{}*, ]+)"), tail(".", strip="{}")),
    types=(Types(rx(rf"^\s*{some_of('abstract case final implicit sealed')}(?:class|object|trait)\s+(\w+)")),),
    functions=(Functions(rx(r"^\s*(?:def|val|var)\s+(\w+)\s*(?:\[[^\]]*\])?\s*\(([^)]*)\)"), params=listed(before_colon), public=silent("private", 5, 20)),),
    calls=Calls(skip=words("case for if match return throw while"), keep=_lower), functions_exported=False,
)

DART = Grammar(
    "dart", "a Dart file", named_type=False,
    imports=each(rx(r"""^import\s+['"]([^'"]+)['"]"""), plain(relative=lambda s: not s.startswith(("dart:", "package:")))),
    types=(Types(rx(rf"^\s*{some_of('abstract mixin')}class\s+(\w+)"), public=no_underscore),),
    functions=(Functions(
        rx(rf"^\s*{some_of('abstract async external static')}(?:[\w<>?\[\]]+\s+)?(\w+)\s*\(([^)]*)\)\s*(?:async\s*)?\s*\{{"),
        params=listed(lambda p: re.sub(r"[{}?=].*\Z", "", last_word(p)).strip()), public=no_underscore, is_async=says("async", 5, 40),
        skip=words("catch for if switch while"),
    ),),
    calls=Calls(skip=words("catch for if return switch throw while"), keep=_lower_or_bar),
)

SHELL = Grammar(
    "shell", "a shell script", imports=each(rx(r"""^(?:source|\.)\s+['"]?([^'";\s]+)['"]?"""), plain(relative=lambda s: True)),
    functions=(Functions(rx(r"^(?:function\s+)?(\w+)\s*\(\s*\)\s*\{"), args=None, public=no_underscore),),
    calls=Calls(
        (re.compile(r"(?:\A|[(;\n]|\|\|?|&&)\s*(\w+)\b", re.A), rx(r"\b(?:elif|if|until|while)\s+(\w+)")),
        words("case cd do done echo elif else esac exit export fi for function if in local printf read return set shift source then trap until while"),
    ),
    repeats=True,
)


def _perl_params(h: Hit, params: list[str], body: str) -> list[str]:
    m = re.search(r"my\s*\(([^)]+)\)\s*=\s*@_", body)
    return [p.strip() for p in m[1].split(",") if p.strip()] if m else []


_PRAGMAS = words("base constant feature lib parent strict utf8 vars warnings")
PERL = Grammar(
    "perl", "a Perl file", unit="sub", heads=lambda src: [m[1] for m in rx(r"^package\s+([\w:]+)\s*;").finditer(src.text)],
    imports=each(rx(r"^(?:require|use)\s+([\w:]+)"), lambda m: None if m[1] in _PRAGMAS else (m[1], [], False)),
    functions=(Functions(rx(r"^sub\s+(\w+)\s*(?:\([^)]*\))?\s*\{"), args=None, from_body=_perl_params, public=no_underscore),),
    calls=Calls(skip=words("defined else elsif for foreach if local my our package print ref require return sub unless until use while")),
)

_END = re.compile(r"\s*@end\s*\Z")


def _to_end(src: Source, first: int) -> int:
    return src.until(first, _END)


def _objc_decl(h: Hit) -> str:
    return h.src.lines[h.src.line_at(h.match.start())]


OBJECTIVE_C = Grammar(
    "objectivec", "an Objective-C file", unit="method",
    imports=each(rx(r'^#(?:import|include)\s+(?:"([^"]+)"|<([^>]+)>)'), lambda m: (m[1] or m[2], [], m[1] is not None)),
    types=(Types(rx(r"^@interface\s+(\w+)\s*(?::\s*(\w+))?"), end=_to_end, extends=2), Types(rx(r"^@implementation\s+(\w+)"), end=_to_end, listed=lambda h: False)),
    functions=(Functions(
        rx(r"^[-+]\s*\([^)]*\)\s*(\w+)"), args=None, only=lambda h: "{" in _objc_decl(h), from_body=lambda h, p, b: re.findall(r":\s*\([^)]*\)\s*(\w+)", _objc_decl(h), re.A)
    ),),
    calls=Calls((rx(r"\[\s*[\w.]+\s+(\w+)"),), words("case else for if return switch while")),
)

ZIG = Grammar(
    "zig", "a Zig file", named_type=False, kind="struct", imports=each(rx(r'@import\(\s*"([^"]+)"\s*\)'), plain(relative=dotted)),
    types=(Types(rx(r"^(pub\s+)?const\s+(\w+)\s*=\s*struct\s*\{"), name=2, public=has(1)),),
    functions=(Functions(rx(r"^(pub\s+)?fn\s+(\w+)\s*\(([^)]*)\)"), name=2, args=3, params=listed(before_colon), public=has(1)),),
    calls=Calls(skip=words("catch fn for if orelse return struct switch try while")),
)

_HIDDEN = re.compile(r"\b(?:internal|private)\b")
SOLIDITY = Grammar(
    "solidity", "a Solidity file", kind="contract", imports=each(rx(r'^import\s+(?:\{[^}]*\}\s+from\s+)?"([^"]+)"'), plain(relative=dotted)),
    types=(Types(rx(r"^(?:abstract\s+)?(?:contract|interface|library)\s+(\w+)(?:\s+is\s+[\w, ]+)?\s*\{")),),
    functions=(Functions(rx(r"^\s*function\s+(\w+)\s*\(([^)]*)\)([^{;]*)\{"), params=listed(last_word), public=lambda h: not _HIDDEN.search(h.group(3))),),
    calls=Calls(skip=words("assert emit for function if require return revert while")),
)


def _ps_params(raw: str) -> list[str]:
    found = (re.sub(r"=.*\Z", "", re.sub(r"^\$", "", re.sub(r"^\[[^\]]+\]\s*", "", p.strip()))).strip() for p in raw.split(","))
    return [p for p in found if p]


def _ps_block(h: Hit, params: list[str], body: str) -> list[str]:
    m = None if params else re.search(r"\bparam\s*\(([^)]*)\)", body, re.I)
    return _ps_params(m[1]) if m else params


POWERSHELL = Grammar(
    "powershell", "a PowerShell script", named_type=False,
    imports=both(each(rx(r"^Import-Module\s+([\w.\\/-]+)"), plain()), each(rx(r"""^\.\s+['"]?([^'";\s]+)['"]?"""), plain(relative=lambda s: True))),
    types=(Types(rx(r"^class\s+(\w+)(?:\s*:\s*(\w+))?\s*\{"), extends=2),),
    functions=(Functions(rx(r"^function\s+([\w-]+)\s*(?:\(([^)]*)\))?\s*\{"), params=_ps_params, from_body=_ps_block),),
    calls=Calls(
        (rx(r"\b([\w-]+)\s*[\s(]"),), words("begin catch else elseif end finally for foreach function if param process return switch try while"),
        lambda n: "-" in n or "A" <= n[0] <= "Z",
    ),
)

GROOVY = Grammar(
    "groovy", "a Groovy file", unit="method", imports=each(rx(r"^import\s+(?:static\s+)?([\w.]+)"), plain()),
    types=(Types(rx(r"^(?:public\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?"), extends=2),),
    functions=(Functions(
        rx(rf"^\s*{some_of('private protected public static')}(?:def|[\w<>\[\],. ]+?)\s+(\w+)\s*\(([^)]*)\)\s*\{{"),
        params=listed(lambda p: re.sub(r"=.*\Z", "", last_word(p))), public=lambda h: not re.search(r"\bprivate\b", h.match[0]),
        skip=words("catch class for if interface switch while"),
    ),),
    calls=Calls(skip=words("catch class def for if new return switch while")),
)

ALL = [JAVA, GO, RUST, c_like("c", "C"), c_like("cpp", "C++"), CSHARP, PHP, KOTLIN, SWIFT, SCALA, DART, SHELL, PERL, OBJECTIVE_C, ZIG, SOLIDITY, POWERSHELL, GROOVY]

