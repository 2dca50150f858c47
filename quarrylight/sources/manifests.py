"""Package manifests, workspaces, and path aliases of TypeScript configurations.

These are a few small files of one repository, so they are read on the driver; what comes of them
are tables to join with.
"""

from __future__ import annotations

import glob
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_FIELDS = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")


@dataclass
class Workspace:
    is_monorepo: bool
    #: (directory, declared packages), the root first
    sources: list[tuple[str, set[str]]] = field(default_factory=list)


def _json(path: Path) -> dict | None:
    try:
        got = json.loads(path.read_text("utf-8", "replace"))
    except (OSError, ValueError):
        return None
    return got if isinstance(got, dict) else None


def read_package(folder: Path) -> tuple[dict, set[str]] | None:
    """(manifest, names it declares in any of its dependency fields), or None."""
    raw = _json(folder / "package.json")
    if raw is None:
        return None
    return raw, {name for f in _FIELDS if isinstance(raw.get(f), dict) for name in raw[f]}


def _strings(x: object) -> list[str] | None:
    got = [g for g in x if isinstance(g, str)] if isinstance(x, list) else []
    return got or None


def _pnpm(root: Path) -> list[str] | None:
    """The list under ``packages:``, which any other text at its level ends."""
    try:
        lines = (root / "pnpm-workspace.yaml").read_text("utf-8", "replace").split("\n")
    except OSError:
        return None
    found, inside = [], False
    for line in (re.sub(r"#.*\Z", "", x) for x in lines):
        if line.strip() == "packages:":
            inside = True
        elif inside and (m := re.match(r"\s*-\s*(.+?)\s*\Z", line)):
            found.append(re.sub(r"^['\"]|['\"]$", "", m[1]))
        elif inside and line.strip():
            inside = False
    return found or None


def _globs(root: Path, manifest: dict | None) -> list[str] | None:
    spaces = (manifest or {}).get("workspaces")
    named = _strings(spaces) or _strings(spaces.get("packages") if isinstance(spaces, dict) else None)
    return named or _pnpm(root) or _strings((_json(root / "lerna.json") or {}).get("packages"))


def _alternatives(pattern: str) -> Iterator[str]:
    """The patterns that braces stand for."""
    m = re.search(r"\{([^{}]*)\}", pattern)
    if not m:
        yield pattern
        return
    for one in m[1].split(","):
        yield from _alternatives(pattern[: m.start()] + one + pattern[m.end() :])


def _matcher(patterns: list[str]):
    one = [re.compile(glob.translate(p, recursive=True, include_hidden=False, seps="/")) for x in patterns for p in _alternatives(x)]
    return lambda path: any(p.match(path) for p in one)


def _files(root: Path, accept) -> list[str]:
    """Relative paths of files that ``accept`` takes; hidden directories and node_modules are left out."""
    found = []
    for at, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if f != "node_modules" and not f.startswith("."))
        base = os.path.relpath(at, root).replace(os.sep, "/")
        found += [p for n in sorted(names) if accept(p := n if base == "." else f"{base}/{n}")]
    return found


def workspace(root: str) -> Workspace:
    """Manifests of the root and of its workspaces: by the root's manifest, else by
    pnpm-workspace.yaml, else by lerna.json; with a turbo.json alone, packages and apps."""
    top = Path(root).resolve()
    own = read_package(top)
    out = Workspace(False, [(str(top), own[1])] if own else [])
    globs = _globs(top, own[0] if own else None)
    out.is_monorepo = globs is not None or (top / "turbo.json").exists()
    if globs is None and out.is_monorepo:
        globs = ["packages/*", "apps/*"]
    if globs:
        taken = _matcher([f"{g.rstrip('/').removeprefix('./')}/package.json" for g in globs if not g.startswith("!")])
        refused = _matcher([f"{g[1:]}/package.json" for g in globs if g.startswith("!")])
        for path in _files(top, lambda p: p.endswith("package.json") and taken(p) and not refused(p)):
            folder = (top / path).parent
            if folder != top and (got := read_package(folder)):
                out.sources.append((str(folder), got[1]))
    out.is_monorepo = out.is_monorepo or len(out.sources) > 1
    return out


def declared(spark: SparkSession, found: Workspace) -> DataFrame:
    """(dir, package): a manifest without any has one row with a null package."""
    rows = [(d, p) for d, names in found.sources for p in (sorted(names) or [None])]
    return spark.createDataFrame(rows, "dir string, package string")


# -- TypeScript and JavaScript configurations --

_EXTENDS_DEPTH = 5
_SOURCES = {".cts", ".js", ".jsx", ".mts", ".ts", ".tsx"}
_JSONC = re.compile(r'("(?:\\.|[^"\\])*+")|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)', re.S)


def parse_jsonc(text: str) -> dict | None:
    """JSON with comments and trailing commas."""
    bare = _JSONC.sub(lambda m: m[1] or "", text)
    try:
        got = json.loads(re.sub(r",(\s*[}\]])", r"\1", bare))
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def _config(path: Path, depth: int = 0) -> tuple[dict | None, Path | None]:
    """(paths, base directory), each from the file or, if it has none, from what it extends by a path."""
    if depth > _EXTENDS_DEPTH:
        return None, None
    try:
        raw = parse_jsonc(path.read_text("utf-8", "replace"))
    except OSError:
        raw = None
    if raw is None:
        return None, None
    options = raw.get("compilerOptions")
    options = options if isinstance(options, dict) else {}
    paths = options.get("paths") if isinstance(options.get("paths"), dict) else None
    base = (path.parent / options["baseUrl"]).resolve() if isinstance(options.get("baseUrl"), str) else None
    parent = raw.get("extends")
    if (paths is None or base is None) and isinstance(parent, str) and parent.startswith((".", "/")):
        more, under = _config((path.parent / (parent if parent.endswith(".json") else parent + ".json")).resolve(), depth + 1)
        paths, base = (more if paths is None else paths), (under if base is None else base)
    return paths, base


def _names_under(folder: Path) -> list[str] | None:
    """Directories and source files, without their endings, that a base URL makes importable."""
    try:
        entries = sorted(folder.iterdir())
    except OSError:
        return None
    seen = [e for e in entries if e.name != "node_modules" and not e.name.startswith(".")]
    return sorted({e.name if e.is_dir() else e.stem for e in seen if e.is_dir() or e.suffix in _SOURCES})


def aliases(root: str) -> list[tuple[str, list[str], list[str] | None]]:
    """(directory, path patterns, names under the base URL) of every configuration that has any. A
    tsconfig of another name beside a tsconfig.json is left out."""
    top = Path(root).resolve()
    named = re.compile(r"(?:.*/)?(?:tsconfig[^/]*|jsconfig)\.json\Z")
    found = [top / p for p in _files(top, named.match)]
    plain = {p.parent for p in found if p.name == "tsconfig.json"}
    out = []
    for path in found:
        if re.search(r"tsconfig\..+\.json\Z", path.name) and path.parent in plain:
            continue
        paths, base = _config(path)
        if paths or base:
            out.append((str(path.parent), list(paths or {}), _names_under(base) if base else None))
    return out


def alias_table(spark: SparkSession, found: list[tuple[str, list[str], list[str] | None]]) -> DataFrame:
    return spark.createDataFrame(found, "dir string, patterns array<string>, base_names array<string>")
