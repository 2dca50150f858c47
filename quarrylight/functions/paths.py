"""Path and name predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TEST = r"(/test/|/tests/|/spec/|/__tests__/|\.test\.|\.spec\.|_test\.|_spec\.|test\.rs$)"
_DEMO = r"(/examples?/|/demos?/|/samples?/|/fixtures/|/__fixtures__/)"


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(slashes(path), "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(slashes(path), "/?[^/]*$", "")


def extension(path: Column) -> Column:
    """The last dot and what follows, '' for none or a leading dot only."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]*$", "$1")


def is_test_file(path: Column) -> Column:
    return F.lower(slashes(path)).rlike(_TEST)


def is_non_core_file(path: Column) -> Column:
    return is_test_file(path) | F.lower(slashes(path)).rlike(_DEMO)


def normalized_name(name: Column) -> Column:
    """Name for comparison across languages: no ``_`` or ``-``, lower case."""
    return F.lower(F.regexp_replace(name, "[_-]", ""))


def resolve(path: Column) -> Column:
    """An absolute path without ``.``, ``..`` and empty segments."""
    parts = F.split(path, "/")
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin("", "."), acc)
        .when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def ancestors(path: Column) -> Column:
    """All directories that contain the path, and the path, without a trailing slash."""
    parts = F.split(F.regexp_replace(slashes(path), "/$", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
