"""JavaScript, TypeScript and their single-file components, and Python: languages in which
references beside calls keep a name alive, and the whole file's references count."""

from __future__ import annotations

import posixpath
import re

from .grammar import class_row, file_row, function_row, rx, stem, words
from .source import Source, complexity, without_noise

_NAME = r"([A-Za-z_$][\w$]*)"
_JS_WORDS = words(
    "async await catch delete do else false for function if in instanceof new null of return super switch this true typeof undefined void while yield"
)
_JS_CALL = rx(r"\b([\w$]+)\s*\(")
_JS_USES = [
    rx(rf"[=:?({{,\[]\s*{_NAME}\s*(?=[\n;:,\]}})])"),  # as a value or an argument
    rx(rf"\breturn\s+{_NAME}\s*(?=[\n;,}})])"),
    rx(rf"\b{_NAME}\s*\.\s*(?=[A-Za-z_$])"),  # its members are used
    rx(rf"\bnew\s+{_NAME}\b"),
    rx(r"<([A-Z]\w*)\b"),  # as a tag
]
_JS_DECLARED = re.compile(r"function\s*\*?\s*\Z", re.A)
_JS_CLASS = rx(r"^[ \t]*(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+(\w+)(?:\s+extends\s+([\w<>., ]+))?(?:\s+implements\s+([\w<>., ]+))?\s*\{")
_JS_FUNCTION = rx(r"^[ \t]*(?:export\s+(default\s+)?)?(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)")
_JS_ARROW = rx(r"^[ \t]*(?:export\s+)?(?:var|let|const)\s+(\w+)\s*=\s*(?:async\s+)?(?:\(([^)]*)\)|(\w+))\s*=>")
_JS_IMPORT = rx(r"""^[ \t]*import\s+(?:type\s+)?(?:([^\r\n]+?)\s+from\s+)?['"]([^\r\n]*?)['"]""")
_JS_REQUIRE = rx(r"""(?:var|let|const)\s+\{?([^}=]+)\}?\s*=\s*require\(['"]([^'"]+)['"]\)""")
_JS_EXPORT = rx(r"^[ \t]*export\s+(?:default\s+)?(?:class|const|enum|function|interface|let|type|var)\s+(\w+)")


def _names(bare: str, call: re.Pattern, uses: list[re.Pattern], declared: re.Pattern, back: int, skip: frozenset[str]) -> list[str]:
    found: dict[str, None] = {}
    for m in call.finditer(bare):
        if m[1] not in skip and not declared.search(bare[max(0, m.start() - back) : m.start()]):
            found[m[1]] = None
    for p in uses:
        for m in p.finditer(bare):
            if m[1] not in skip:
                found[m[1]] = None
    return list(found)


def _js_names(code: str, own: str | None = None) -> list[str]:
    skip = _JS_WORDS if own is None else _JS_WORDS | {own}
    return _names(without_noise(code), _JS_CALL, _JS_USES, _JS_DECLARED, 12, skip)


def _js_params(raw: str) -> list[str]:
    return [q for p in raw.split(",") if (q := re.sub(r"[=:][^,]*", "", p.strip()).strip())]


def _js_symbols(raw: str) -> list[str]:
    raw = re.sub(r"\{([^}]*)\}", r"\1", raw, count=1)
    raw = re.sub(r"\*\s+as\s+\w+", "", raw, count=1)
    return [q for p in raw.split(",") if (q := re.sub(r"\s+as\s+\w+", "", p, count=1).strip())]


def _common_js(text: str):
    """Whether a name is put on module.exports, on exports, or into an object given to it."""
    if "exports" not in text:
        return lambda name: False

    def exported(name: str) -> bool:
        n = re.escape(name)
        return bool(re.search(rf"exports\s*\.\s*{n}\b|module\.exports\s*=\s*(?:{n}\b|\{{[^}}]*\b{n}\b[^}}]*\}})", text, re.A))

    return exported


def javascript(text: str, path: str, language: str | None = None) -> dict:
    src = Source(text, path)
    language = language or ("typescript" if posixpath.splitext(path)[1].lower() in (".ts", ".tsx") else "javascript")
    imports = [(m[2], _js_symbols(m[1] or ""), m[2].startswith(".")) for m in _JS_IMPORT.finditer(text)]
    imports += [(m[2], [n for x in m[1].split(",") if (n := x.strip())], m[2].startswith(".")) for m in _JS_REQUIRE.finditer(text)]
    exports = [m[1] for m in _JS_EXPORT.finditer(text)]
    classes = []
    for m in _JS_CLASS.finditer(text):
        first = src.line_at(m.start())
        public = "export" in text[max(0, m.start() - 20) : m.start()]
        classes.append(class_row(m[1], first, src.balanced(first), (m[2] or "").strip() or None, [x.strip() for x in m[3].split(",")] if m[3] else [], public))
    functions: list[dict] = []
    common = _common_js(text)
    at_lines: dict[str, list[int]] = {}

    def add(m: re.Match, name: str, params: list[str], reach: int, default: bool | None) -> None:
        first = src.line_at(m.start())
        if default is None and any(abs(x - first) < 2 for x in at_lines.get(name, [])):
            return
        last = src.balanced(first)
        body = src.body(first, last)
        public = "export" in text[max(0, m.start() - 5) : m.start() + 10] or common(name)
        is_async = "async" in text[m.start() : m.start() + reach]
        functions.append(function_row(name, first, last, params, public, _js_names(body, name), complexity(body), is_async, default))
        at_lines.setdefault(name, []).append(first)

    for m in _JS_FUNCTION.finditer(text):
        add(m, m[2], _js_params(m[3]), 30, bool(m[1]))
    for m in _JS_ARROW.finditer(text):
        add(m, m[1], _js_params(m[2] if m[2] is not None else m[3]), 50, None)
    n, s = len(functions), lambda k: "" if k == 1 else "s"
    if exports:
        listed = ", ".join(exports[:3]) + ("…" if len(exports) > 3 else "")
        told = f"{stem(path)} exports {len(exports)} symbol{s(len(exports))} ({listed}), with {n} function{s(n)} defined."
    else:
        told = f"{stem(path)} defines {n} function{s(n)}, with imports of {len(imports)} module{s(len(imports))}."
    return file_row(src, language, functions, classes, imports, exports, _js_names(text), told)


_SCRIPT = re.compile(r"<script\b([^>]*)>", re.I | re.A)
_SCRIPT_END = re.compile(r"</script>", re.I)


def component(language: str, title: str):
    """Vue and Svelte files: the first script block, with its lines counted in the file."""

    def parse(text: str, path: str) -> dict:
        name = path.split("/")[-1]
        head = _SCRIPT.search(text)
        end = _SCRIPT_END.search(text, head.end()) if head else None
        if not head or not end:
            return file_row(Source(text, path), language, [], [], [], [], explanation=f"{name} is a {title} component without a <script> block.")
        out = javascript(text[head.end() : end.start()], path, language)
        down = text.count("\n", 0, head.end())
        for row in out["functions"] + out["classes"]:
            row["start_line"] += down
            row["end_line"] += down
        out["line_count"] = text.count("\n") + 1
        n = len(out["functions"])
        out["explanation"] = f"{name} is a {title} component whose <script> block has {n} function{'' if n == 1 else 's'}."
        return out

    return parse


_PY_WORDS = words(
    "False None True and as assert async await break class cls continue def del elif else except finally for from global if import in is isinstance "
    "lambda len nonlocal not or pass print raise range return self try while with yield"
)
_PY_NAME = r"([A-Za-z_]\w*)"
_PY_CALL = rx(rf"\b{_PY_NAME}\s*\(")
_PY_USES = [rx(rf"[=:({{,\[]\s*{_PY_NAME}\s*(?=[\n;:,\]}})])"), rx(rf"\breturn\s+{_PY_NAME}\s*(?=[\n;,\]}})])"), rx(rf"@\s*{_PY_NAME}")]
_PY_DECLARED = re.compile(r"def\s*\Z", re.A)
_PY_FUNCTION = rx(r"^( *)(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)\s*(?:->[^\r\n]*?)?:")
_PY_CLASS = rx(r"^( *)class\s+(\w+)(?:\s*\([^)]*\))?\s*:")
_PY_IMPORT = rx(r"^(?:from\s+(\S+)\s+import\s+([\s\S]+?)|import\s+([\w.,\s]+))(?=[\r\n]|\Z)")


def _py_names(code: str, own: str | None = None) -> list[str]:
    skip = _PY_WORDS if own is None else _PY_WORDS | {own}
    return _names(without_noise(code), _PY_CALL, _PY_USES, _PY_DECLARED, 10, skip)


def _py_params(raw: str) -> list[str]:
    found = (re.sub(r"^\*{1,2}", "", re.sub(r"[=:].*\Z", "", p.strip())).strip() for p in raw.split(","))
    return [p for p in found if p and p not in ("self", "cls")]


def _bare(raw: str) -> list[str]:
    """Items of an import list without what they are renamed to."""
    return [q for p in raw.split(",") if (q := re.sub(r"\s+as\s+\w+", "", p.strip(), count=1))]


def python(text: str, path: str) -> dict:
    src = Source(text, path)
    imports = []
    for m in _PY_IMPORT.finditer(text):
        if m[1] is not None:
            imports.append((m[1], _bare(m[2]), m[1].startswith(".")))
        else:
            imports += [(x, [], False) for x in _bare(m[3])]
    exports, classes, functions = [], [], []
    for m in _PY_CLASS.finditer(text):
        first = src.line_at(m.start())
        classes.append(class_row(m[2], first, src.indented(first), None, [], not m[1]))
        if not m[1]:
            exports.append(m[2])
    for m in _PY_FUNCTION.finditer(text):
        first = src.line_at(m.start())
        last = src.indented(first)
        body = src.body(first, last)
        public = not m[1] and not m[2].startswith("_")
        functions.append(function_row(m[2], first, last, _py_params(m[3]), public, _py_names(body, m[2]), complexity(body), "async" in text[m.start() : m.start() + 20]))
        if public:
            exports.append(m[2])
    n, base = len(functions), posixpath.basename(path).removesuffix(".py")
    fns = f"{n} function{'' if n == 1 else 's'}"
    if classes:
        told = f"{base} defines {len(classes)} class{'es' if len(classes) > 1 else ''} ({', '.join(c['name'] for c in classes[:2])}) and {fns}."
    else:
        told = f"{base} is a Python module with {fns}."
    return file_row(src, "python", functions, classes, imports, list(dict.fromkeys(exports)), _py_names(text), told)
