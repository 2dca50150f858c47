"""Languages by file name, in Python and as a column expression."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.paths import basename

_BY_LANGUAGE = """
batch bat cmd|c c h|clojure clj cljc cljs|cpp cc cpp cxx hpp|crystal cr|csharp cs|css css scss|dart dart|elisp el|elixir ex exs|erlang erl hrl
fsharp fs fsx|go go|graphql gql graphql|groovy gradle groovy|haskell hs lhs|html htm html|java java|javascript cjs js jsx mjs|julia jl|kotlin kt kts
lua lua|makefile mk|nim nim|objectivec m mm|ocaml ml mli|perl pl pm|php php|powershell ps1 psd1 psm1|protobuf proto|python py|r r|ruby rb|rust rs
scala scala|shell bash sh|solidity sol|sql sql|svelte svelte|swift swift|terraform tf tfvars|typescript ts tsx|vimscript vim|vue vue|yaml yaml yml|zig zig
"""
#: extension -> language
EXTENSIONS: dict[str, str] = {
    "." + ext: row.split()[0] for line in _BY_LANGUAGE.strip().splitlines() for row in line.split("|") for ext in row.split()[1:]
}
#: whole names -> language; a name and a dot before anything else counts as well for the last two
NAMES: dict[str, str] = {"gnumakefile": "makefile", "makefile": "makefile", "dockerfile": "dockerfile"}
#: no grammar: lines are counted, nothing else
LINES_ONLY = frozenset({"css", "html", "r", "yaml"})


def extension_of(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path.replace("\\", "/")))[1].lower()


def detect(path: str) -> str:
    base = posixpath.basename(path.replace("\\", "/")).lower()
    if base in NAMES:
        return NAMES[base]
    for head in ("dockerfile", "makefile"):
        if base.startswith(head + "."):
            return head
    return EXTENSIONS.get(extension_of(path), "unknown")


def language_of(path: Column) -> Column:
    """The same as an expression: a constant map and no join."""
    base = F.lower(basename(path))
    ext = F.regexp_extract(base, r"^.+(\.[^.]*)$", 1)
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    out = F
    for name, language in NAMES.items():
        out = out.when(base == name, language)
    return out.when(base.startswith("dockerfile."), "dockerfile").when(base.startswith("makefile."), "makefile").otherwise(F.coalesce(known[ext], F.lit("unknown")))
