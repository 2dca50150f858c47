"""Chat formatting (operator 8).

A finite-state machine over roles validates the turn order of each conversation; a valid
one is emitted as text segments with a loss flag each, from a declarative template. Turns
are gathered by one shuffle on the conversation's id; the machine is a fold over its roles
with native higher-order functions.

Defined cases: a null role, or one that the machine does not know, two turns with the same
number (repeated rows included) and a null turn number make a conversation invalid; a null
text is an empty text; an empty text still gives its (empty) content segment; rows with a
null conv_id are one conversation; an invalid conversation gives one row with segment
-1, no text and the reason in ``error``; an empty table gives an empty result. Only the four
named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Machine:
    """state -> role -> next state; a conversation must end in one of ``accept``."""

    start: str
    moves: dict[str, dict[str, str]]
    accept: frozenset[str]


@dataclass(frozen=True)
class Template:
    """role -> [(text, loss)]; ``{text}`` stands for the turn's text. ``head`` opens a conversation."""

    turns: dict[str, list[tuple[str, int]]]
    head: list[tuple[str, int]] = field(default_factory=list)


MACHINE = Machine(
    start="start",
    moves={
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user", "tool": "tool"},
        "tool": {"assistant": "assistant", "tool": "tool"},
    },
    accept=frozenset({"assistant"}),
)
TEMPLATE = Template(
    turns={
        "system": [("<|begin|>system\n", 0), ("{text}", 0), ("<|end|>\n", 0)],
        "user": [("<|begin|>user\n", 0), ("{text}", 0), ("<|end|>\n", 0)],
        "assistant": [("<|begin|>assistant\n", 0), ("{text}", 1), ("<|end|>\n", 1)],
        "tool": [("<|begin|>tool\n", 0), ("{text}", 0), ("<|end|>\n", 0)],
    }
)


def _final_state(turns: Column, machine: Machine) -> Column:
    moves = [x for s, to in machine.moves.items() for r, n in to.items() for x in (F.lit(f"{s}\x1f{r}"), F.lit(n))]
    table = F.create_map(*moves)
    return F.aggregate(
        turns,
        F.lit(machine.start),
        lambda state, t: F.coalesce(F.try_element_at(table, F.concat_ws("\x1f", state, F.coalesce(t["role"], F.lit("?")))), F.lit("!")),
    )


def _segments(turns: Column, template: Template) -> Column:
    def of(parts: list[tuple[str, int]], role: Column, turn: Column, text: Column) -> Column:
        return F.array(
            *[
                F.struct(turn.alias("turn"), role.alias("role"), (text if s == "{text}" else F.lit(s)).alias("text"), F.lit(loss).alias("loss"))
                for s, loss in parts
            ]
        )

    def turn(t: Column) -> Column:
        out = None
        for role, parts in template.turns.items():
            out = (F if out is None else out).when(t["role"] == role, of(parts, t["role"], t["turn"], F.coalesce(t["text"], F.lit(""))))
        return out

    body = F.flatten(F.transform(turns, turn))
    if template.head:
        body = F.concat(of(template.head, F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit("")), body)
    return body


def format_chats(conversations: DataFrame, machine: Machine = MACHINE, template: Template = TEMPLATE) -> DataFrame:
    """(conv_id, segment, turn, role, text, loss, error), segments numbered from 0."""
    c = conversations.select(
        F.col("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text")).alias("t")
    )
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    numbers = F.transform("turns", lambda t: t["turn"])
    end = _final_state(F.col("turns"), machine)
    g = g.withColumn(
        "error",
        F.when(F.exists(numbers, lambda x: x.isNull()), "null turn")
        .when(F.size(F.array_distinct(numbers)) < F.size(numbers), "repeated turn")
        .when(end == "!", "bad order")
        .when(~end.isin(*sorted(machine.accept)), "unfinished"),
    )
    none = F.array(
        F.struct(F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("loss"))
    )
    g = g.select("conv_id", "error", F.posexplode(F.when(F.col("error").isNull(), _segments(F.col("turns"), template)).otherwise(none)).alias("pos", "s"))
    return g.select(
        "conv_id",
        F.when(F.col("error").isNull(), F.col("pos")).otherwise(-1).alias("segment"),
        F.col("s.turn").alias("turn"),
        F.col("s.role").alias("role"),
        F.col("s.text").alias("text"),
        F.col("s.loss").alias("loss"),
        "error",
    )


def sql(conversations: str = "conversations") -> str:
    """DuckDB SQL of the default machine, in which the state is the last role, and template."""
    allowed = ", ".join(f"('{s}', '{r}')" for s, to in MACHINE.moves.items() for r in to)
    parts = ", ".join(
        f"('{r}', {i}, {'NULL' if s == '{text}' else chr(39) + s.replace(chr(10), '') + chr(39)}, {int(s.endswith(chr(10)))}, {loss})"
        for r, p in TEMPLATE.turns.items()
        for i, (s, loss) in enumerate(p)
    )
    return f"""
WITH moves(a, b) AS (VALUES {allowed}),
parts(prole, i, fixed, nl, loss) AS (VALUES {parts}),
c AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 'start' ELSE '?' END) AS prev,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM {conversations}),
v AS (SELECT conv_id, CASE WHEN count(*) > count(turn) THEN 'null turn' WHEN count(*) > count(DISTINCT turn) THEN 'repeated turn'
  WHEN count(*) FILTER (WHERE b IS NULL) > 0 THEN 'bad order' WHEN max(CASE WHEN n = total AND role = 'assistant' THEN 1 ELSE 0 END) = 0 THEN 'unfinished' END AS error
  FROM c LEFT JOIN moves ON prev = a AND role = b GROUP BY conv_id)
SELECT c.conv_id, CAST((n - 1) * 3 + i AS INTEGER) AS segment, turn, role, CASE WHEN fixed IS NULL THEN coalesce(text, '') ELSE fixed || CASE WHEN nl = 1 THEN chr(10) ELSE '' END END AS text,
  CAST(loss AS INTEGER) AS loss, NULL::VARCHAR AS error
FROM c JOIN v ON c.conv_id IS NOT DISTINCT FROM v.conv_id JOIN parts ON role = prole WHERE v.error IS NULL
UNION ALL SELECT conv_id, -1, NULL, NULL, NULL, 0, error FROM v WHERE error IS NOT NULL"""
