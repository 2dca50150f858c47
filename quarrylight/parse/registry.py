"""Parsers by language, and the table of parsed files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PARSED
from . import braces, layout, scripts, tables
from .grammar import Grammar, file_row
from .languages import EXTENSIONS, LINES_ONLY, detect
from .source import Source

#: (text, path) -> one row of the parsed table without its path
Parser = Callable[[str, str], dict]


def by_grammar(grammar: Grammar) -> Parser:
    return lambda text, path: grammar.parse(Source(text, path))


PARSERS: dict[str, Parser] = {
    **{g.language: by_grammar(g) for g in (*braces.ALL, *layout.ALL)},
    "javascript": scripts.javascript, "typescript": scripts.javascript, "python": scripts.python,
    "vue": scripts.component("vue", "Vue"), "svelte": scripts.component("svelte", "Svelte"),
    "haskell": layout.haskell, "erlang": layout.erlang, "makefile": tables.makefile, "dockerfile": tables.dockerfile, "terraform": tables.terraform,
    "sql": tables.sql, "protobuf": tables.protobuf, "graphql": tables.graphql, "batch": tables.batch,
}


def register_parser(language: str, parser: Parser, extensions: tuple[str, ...] = ()) -> None:
    """Add or replace a language; ``extensions`` with their dot are detected as it. Call it before
    ``parse_files``, which sends the parsers that are registered then to the executors."""
    PARSERS[language] = parser
    EXTENSIONS.update(dict.fromkeys(extensions, language))


def minimal(text: str, path: str, language: str) -> dict:
    """What is known about a file without a grammar, or one that its parser fails on."""
    told = f"{path.split('/')[-1]} is a {language} file of which only lines are counted."
    return file_row(Source(text, path), language, [], [], [], [], explanation=told)


def parse_text(text: str, path: str, language: str | None = None, parsers: dict[str, Parser] | None = None) -> dict:
    """One file. Its language follows from the path if it is not given."""
    language = language or detect(path)
    parser = (PARSERS if parsers is None else parsers).get(language)
    if parser is None or language in LINES_ONLY:
        return minimal(text, path, language)
    try:
        return parser(text, path)
    except Exception:  # noqa: BLE001 - one malformed file must not end the analysis of a repository
        return minimal(text, path, language)


def _schema() -> pa.Schema:
    s, i, b = pa.string(), pa.int32(), pa.bool_()
    function = pa.struct([
        ("name", s), ("start_line", i), ("end_line", i), ("parameters", pa.list_(s)), ("is_exported", b), ("is_default_export", b), ("is_async", b),
        ("calls", pa.list_(s)), ("complexity", i), ("line_count", i),
    ])
    kind = pa.struct([("name", s), ("start_line", i), ("end_line", i), ("extends", s), ("implements", pa.list_(s)), ("is_exported", b)])
    imported = pa.struct([("source", s), ("symbols", pa.list_(s)), ("is_relative", b)])
    return pa.schema([
        ("file_path", s), ("language", s), ("line_count", i), ("complexity", pa.float64()), ("explanation", s), ("exports", pa.list_(s)),
        ("module_level_calls", pa.list_(s)), ("functions", pa.list_(function)), ("classes", pa.list_(kind)), ("imports", pa.list_(imported)),
    ])


#: Rows that are turned to Arrow at once.
_ROWS = 256
#: Tasks for each core, where files are dealt out anew.
_PER_CORE = 4


def parse_files(files: DataFrame) -> DataFrame:
    """The parsed table (model.PARSED) of ``files``(file_path, content): one row each, in Arrow
    batches. A null content counts as empty, a null path has no language."""
    added = {k: v for k, v in PARSERS.items() if getattr(v, "__module__", "").split(".")[0] != __name__.split(".")[0]}
    known = dict(EXTENSIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import registry

        EXTENSIONS_ = registry.EXTENSIONS
        EXTENSIONS_.update(known)
        parsers, schema = registry.PARSERS | added, _schema()
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                paths = part.column(0).to_pylist()
                rows = [
                    {"file_path": p, **registry.parse_text(t or "", p or "", parsers=parsers)}
                    for p, t in zip(paths, part.column(1).to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _dealt(files.select("file_path", "content")).mapInArrow(run, PARSED)


def _dealt(files: DataFrame) -> DataFrame:
    """The rows over all cores. Parsing costs far more than reading: a table that is small as a file,
    or comes in few row groups, would be parsed by one or two tasks."""
    spark = files.sparkSession
    tasks = max(_PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(tasks, "file_path", "content")


# -- fact tables of the parsed table --


def files_of(parsed: DataFrame) -> DataFrame:
    n = {f"n_{c}": F.size(c) for c in ("functions", "classes", "imports", "exports")}
    return parsed.select("file_path", "language", "line_count", "complexity", "explanation", "exports", *[v.alias(k) for k, v in n.items()])


def functions_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_path", "language", F.posexplode("functions").alias("fn_ord", "f")).select("file_path", "language", "fn_ord", "f.*")


def calls_of(parsed: DataFrame) -> DataFrame:
    """Calls of functions and, without a caller, the references of whole files."""
    inner = parsed.select("file_path", "language", F.explode("functions").alias("f")).select(
        "file_path", "language", F.concat("f.name", F.lit("@"), "file_path").alias("caller"), F.explode("f.calls").alias("callee")
    )
    outer = parsed.select("file_path", "language", F.lit(None).cast("string").alias("caller"), F.explode("module_level_calls").alias("callee"))
    return inner.unionByName(outer)


def imports_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_path", F.explode("imports").alias("i")).select("file_path", "i.*")


def classes_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_path", "language", F.posexplode("classes").alias("ord", "c")).select("file_path", "language", "ord", "c.*")
