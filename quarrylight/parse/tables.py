"""Build files, schemas and other formats without ordinary functions."""

from __future__ import annotations

import posixpath
import re
from itertools import pairwise

from .grammar import Calls, class_row, file_row, first_word, function_row, rx, stem, words
from .source import Source, complexity


def _count(n: int, noun: str) -> str:
    return f"{n} {noun}{'' if n == 1 else 's'}"


def _unique(names: list[str]) -> list[str]:
    return list(dict.fromkeys(names))


_TARGET = rx(r"^([\w.%/-]+)\s*:(?!=)\s*([^\r\n]*)")
_INCLUDE = rx(r"^-?include\s+([^\r\n]+)")
_MAKE = rx(r"\$\(MAKE\)\s+([\w.%/-]+)|make\s+([\w.%/-]+)")


def _recipe(src: Source, first: int) -> int:
    """Blank lines and lines that begin with a tab."""
    last = first
    for i in range(first + 1, len(src.lines)):
        if src.lines[i].strip() and not src.lines[i].startswith("\t"):
            break
        last = i
    return last


def makefile(text: str, path: str) -> dict:
    src, functions = Source(text, path), []
    for m in _TARGET.finditer(text):
        if m[1].startswith("."):
            continue
        first = src.line_at(m.start())
        last = _recipe(src, first)
        body, needs = src.body(first, last), m[2].split()
        calls = _unique(needs + [x[1] or x[2] for x in _MAKE.finditer(body)])
        functions.append(function_row(m[1], first, last, needs, True, calls, complexity(body)))
    imports = [(s, [], True) for m in _INCLUDE.finditer(text) if (s := m[1].strip())]
    told = f"{posixpath.basename(path)} defines {_count(len(functions), 'target')}."
    return file_row(src, "makefile", functions, [], imports, _unique([f["name"] for f in functions]), explanation=told)


_FROM = rx(r"^FROM\s+(?:--platform=\S+\s+)?(\S+)(?:\s+AS\s+([\w-]+))?", re.I)
_COPY = rx(r"^COPY\s+--from=(\S+)", re.I)


def dockerfile(text: str, path: str) -> dict:
    """A stage reaches to the next FROM."""
    src = Source(text, path)
    heads = list(_FROM.finditer(text))
    imports, stages = [], set()
    for m in heads:
        stages.add(m[2])
        imports.append((m[1], [], m[1] in stages))
    imports += [(m[1], [], True) for m in _COPY.finditer(text)]
    at = [src.line_at(m.start()) for m in heads] + [len(src.lines)]
    classes = [class_row(m[2] or f"stage-{i}", a, b - 1, m[1], [], True) for i, (m, (a, b)) in enumerate(zip(heads, pairwise(at), strict=True))]
    told = f"{posixpath.basename(path)} defines {_count(len(classes), 'build stage')}."
    return file_row(src, "dockerfile", [], classes, imports, _unique([c["name"] for c in classes]), explanation=told)


_TF_BLOCK = rx(r'^(data|module|output|provider|resource|variable)\s+"([\w-]+)"(?:\s+"([\w-]+)")?\s*\{')
_TF_SOURCE = rx(r'\bsource\s*=\s*"([^"]+)"')


def terraform(text: str, path: str) -> dict:
    src = Source(text, path)
    classes, imports = [], []
    for m in _TF_BLOCK.finditer(text):
        first = src.line_at(m.start())
        last = src.balanced(first)
        if m[1] == "module" and (s := _TF_SOURCE.search(src.body(first, last))):
            imports.append((s[1], [], s[1].startswith(".")))
        classes.append(class_row(f"{m[2]}.{m[3]}" if m[3] else m[2], first, last, m[1], [], True))
    told = f"{stem(path)} defines {_count(len(classes), 'Terraform block')}."
    return file_row(src, "terraform", [], classes, imports, _unique([c["name"] for c in classes]), explanation=told)


_SQL_TABLE = rx(r'^CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[\["`]?([\w.]+)[\]"`]?\s*\(', re.I)
_SQL_ROUTINE = rx(r'^CREATE\s+(?:OR\s+REPLACE\s+)?(?:FUNCTION|PROCEDURE)\s+[\["`]?([\w.]+)[\]"`]?\s*\(([^)]*)\)', re.I)
_SQL_END = re.compile(r"END\s*;?\s*\${0,2}\s*;?\Z", re.I)
_SQL_NEXT = re.compile(r"CREATE\s+(?:OR\s+REPLACE\s+)?(?:FUNCTION|PROCEDURE|TABLE)\b", re.I)
_SQL_CALLS = Calls(skip=words("begin case declare end from if select when where"), fold=True)


def _routine_end(src: Source, first: int) -> int:
    for i in range(first + 1, len(src.lines)):
        line = src.lines[i].strip()
        if _SQL_END.match(line):
            return i
        if _SQL_NEXT.match(line):
            return i - 1
    return len(src.lines) - 1


def sql(text: str, path: str) -> dict:
    src = Source(text, path)
    classes, functions = [], []
    for m in _SQL_TABLE.finditer(text):
        opened = src.line_at(text.index("(", m.start()))
        classes.append(class_row(m[1], src.line_at(m.start()), src.parens(opened), None, [], True))
    for m in _SQL_ROUTINE.finditer(text):
        first = src.line_at(m.start())
        last = _routine_end(src, first)
        body = src.body(first, last)
        params = [w for p in m[2].split(",") if (w := first_word(p.strip()))]
        functions.append(function_row(m[1], first, last, params, True, _SQL_CALLS.find(body, m[1]), complexity(body)))
    parts = [_count(len(x), noun) for x, noun in ((classes, "table"), (functions, "routine")) if x]
    base = posixpath.basename(path).removesuffix(".sql")
    told = f"{base} defines {' and '.join(parts)}." if parts else f"{base} is a SQL file."
    return file_row(src, "sql", functions, classes, [], _unique([c["name"] for c in classes] + [f["name"] for f in functions]), explanation=told)


_PB_BLOCK = rx(r"^(enum|message|service)\s+(\w+)\s*\{")
_PB_RPC = rx(r"^\s*rpc\s+(\w+)\s*\(([^)]*)\)\s*returns\s*\([^)]*\)")
_PB_IMPORT = rx(r'^import\s+(?:public\s+)?"([^"]+)"')


def protobuf(text: str, path: str) -> dict:
    src = Source(text, path)
    classes, functions = [], []
    for m in _PB_BLOCK.finditer(text):
        first = src.line_at(m.start())
        classes.append(class_row(m[2], first, src.balanced(first), m[1], [], True))
    for m in _PB_RPC.finditer(text):
        first, asked = src.line_at(m.start()), re.sub(r"^stream\s+", "", m[2]).strip()
        functions.append(function_row(m[1], first, first, [asked] if asked else [], True, [], 1))
    imports = [(m[1], [], "/" not in m[1] or m[1].startswith(".")) for m in _PB_IMPORT.finditer(text)]
    told = f"{stem(path)} defines {_count(len(classes), 'message or service block')} and {_count(len(functions), 'RPC method')}."
    return file_row(src, "protobuf", functions, classes, imports, _unique([c["name"] for c in classes] + [f["name"] for f in functions]), explanation=told)


_GQL_TYPE = rx(r"^(enum|input|interface|type)\s+(\w+)(?:\s+implements\s+[\w\s&]+)?\s*\{")
_GQL_FIELD = rx(r"^\s*(\w+)\s*\(([^)]*)\)\s*:")


def graphql(text: str, path: str) -> dict:
    """Fields with arguments are functions of one line."""
    src = Source(text, path)
    classes, functions, exports = [], [], []
    for m in _GQL_TYPE.finditer(text):
        first = src.line_at(m.start())
        last = src.balanced(first)
        classes.append(class_row(m[2], first, last, m[1], [], True))
        exports.append(m[2])
        body = src.body(first, last)
        for f in _GQL_FIELD.finditer(body):
            line = first + body.count("\n", 0, f.start())
            params = [n for p in f[2].split(",") if (n := re.split(r"\s*:", p.strip())[0].strip())]
            functions.append(function_row(f[1], line, line, params, True, [], 1))
            exports.append(f[1])
    told = f"{stem(path)} defines {_count(len(classes), 'type')} and {_count(len(functions), 'resolver field')}."
    return file_row(src, "graphql", functions, classes, [], _unique(exports), explanation=told)


_LABEL = rx(r"^:([\w-]+)\s*(?=[\r\n]|\Z)")
_BAT_SCRIPT = rx(r'^\s*call\s+"?([\w.\\/ -]+\.(?:bat|cmd))"?', re.I)
_BAT_JUMP = rx(r"\b(?:call|goto)\s+:([\w-]+)", re.I)


def batch(text: str, path: str) -> dict:
    """A label reaches to the next one; ``eof`` is none."""
    src = Source(text, path)
    labels = [m for m in _LABEL.finditer(text) if m[1].lower() != "eof"]
    at = [src.line_at(m.start()) for m in labels] + [len(src.lines)]
    functions = []
    for m, (first, end) in zip(labels, pairwise(at), strict=True):
        body = src.body(first, end - 1)
        calls = _unique([n for x in _BAT_JUMP.finditer(body) if (n := x[1]).lower() != "eof" and n != m[1]])
        functions.append(function_row(m[1], first, end - 1, [], True, calls, complexity(body)))
    imports = [(s, [], True) for m in _BAT_SCRIPT.finditer(text) if (s := m[1].strip())]
    told = f"{posixpath.basename(path)} is a batch script with {_count(len(functions), 'label')}."
    return file_row(src, "batch", functions, [], imports, [f["name"] for f in functions], explanation=told)
