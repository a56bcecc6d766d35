"""Chat formatting by a finite-state machine over roles (operator 9, native).

A declarative :class:`Template` names the states, which role may follow in each, the roles whose
text is trained on, and the markers of a turn.  Turns are read in order; each gives three
segments (header, text, end marker) with a loss flag, true for the text of a loss role.  Control
strings inside texts and roles are escaped with a backslash, which is escaped itself, so the
formatted string can be split at its markers and read back exactly.

Defined results: null texts and roles count as empty; null conversation ids are one
conversation; turns are ordered by turn number (null first), then role, then text, and repeated
rows are repeated turns.  Conversations that break the turn order are formatted like the others,
with ``valid`` false and the number of the first turn that does not fit.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: State after a turn that no move allows.
DEAD = ""


@dataclasses.dataclass(frozen=True)
class Template:
    """Turn markers, roles under the loss, and the machine: state -> {role: next state}."""

    opening: str = "<turn:"
    after_role: str = ">"
    closing: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "told"), ("start", "user", "asked"), ("told", "user", "asked"),
        ("asked", "assistant", "answered"), ("answered", "user", "asked"))
    final: tuple[str, ...] = ("answered",)

    def controls(self) -> tuple[str, ...]:
        """Strings that must not occur inside a text."""
        return (self.opening, self.closing.strip())


def escape(text: Column, template: Template, more: str = "") -> Column:
    """Backslashes doubled; a backslash put after the first character of each control string, and
    before each character of ``more``."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in template.controls():
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    for c in more:
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    return out


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: its id, ``valid``, ``first_bad_turn`` (from 1; one past the last turn if
    the conversation stops short), ``segments`` (array of text and loss flag) and ``formatted``."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def step(acc: Column, t: Column) -> Column:
        state = F.lit(DEAD)
        for here, role, there in template.moves:
            state = F.when((acc["state"] == here) & (t["role"] == role), F.lit(there)).otherwise(state)
        return F.struct(state.alias("state"), (acc["seen"] + F.when(acc["state"] != DEAD, 1).otherwise(0)).alias("seen"))

    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("seen"))
    end = F.aggregate("turns", begin, step)

    def parts(t: Column) -> Column:
        header = F.concat(F.lit(template.opening), escape(t["role"], template, template.after_role[0]), F.lit(template.after_role))
        return F.array(F.struct(header.alias("text"), F.lit(False).alias("loss")),
                       F.struct(escape(t["text"], template).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
                       F.struct(F.lit(template.closing).alias("text"), F.lit(False).alias("loss")))

    out = convs.select("conv", end.alias("end"), F.flatten(F.transform("turns", parts)).alias("segments"))
    done = F.col("end.state").isin(*template.final)
    return out.select(
        F.col("conv").alias(conv_col), F.coalesce(done, F.lit(False)).alias("valid"),
        F.when(F.col("end.state") == DEAD, F.col("end.seen")).when(~done, F.col("end.seen") + 1).alias("first_bad_turn"),
        "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    pieces = F.split(formatted, r"\Q" + template.closing + r"\E")
    whole = F.slice(pieces, 1, F.size(pieces) - 1)
    head = r"(?s)^\Q" + template.opening + r"\E([^\\" + template.after_role[0] + r"]*+(?:\\.[^\\" + template.after_role[0] + r"]*+)*+)" \
        + r"\Q" + template.after_role + r"\E(.*)$"
    return F.transform(whole, lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"),
                                                 unescape(F.regexp_extract(p, head, 2)).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


#: The digests of the ``op9`` query in DuckDB SQL, from the turns themselves.
CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (SELECT *, replace(replace(replace(text, '\', '\\'), '<turn:', '<\turn:'), '</turn>', '<\/turn>') AS safe,
                   replace(replace(replace(replace(role, '\', '\\'), '<turn:', '<\turn:'), '</turn>', '<\/turn>'), '>', '\>') AS mark,
                   lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM rows),
checked AS (SELECT *, CASE coalesce(before, 'start') WHEN 'start' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
                      WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END AS fits FROM escaped)
SELECT conv_id, count(*)::bigint AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::bigint AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn:' || mark || '>' || safe || '</turn>' || chr(10)))::bigint AS formatted_chars,
       coalesce(bool_and(fits), false) AND coalesce(arg_max(role, (turn, role, text)), '') = 'assistant' AS valid
FROM checked GROUP BY conv_id
"""
