"""Chat formatting: a template says what stands before and after the turns of a role and what is learned, a machine over roles says which order is valid.

Everything is DataFrame functions. A turn's segments are made where it is read; a conversation's turns meet in one shuffle, in the order of their
numbers, and the machine runs over their roles. The texts of a conversation are one row, as its digest needs them: a conversation is a training document of
2 GB at most, whatever the number of conversations.

Control strings within texts get one more mark after their first character, those that have marks there already too, so that taking
one away restores every text.

Defined results: a null text is empty; a null role is an empty one; a role that the template doesn't name, the empty one too, is written between marks of its
own, not learned and not valid; rows of the same turn are ordered by role and text; null turns come first; rows without a conv_id are one conversation; repeated
rows are turns; an empty table gives no rows. Other columns are left aside.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    """What stands before and after a turn's text, and whether the text is learned."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """Turns by role, and the machine: moves[state, role] is the next state, a conversation is valid if it ends in one of ``ends``."""

    turns: Mapping[str, Turn]
    controls: tuple[str, ...]
    moves: Mapping[tuple[str, str], str]
    start: str
    ends: frozenset[str]
    #: Other roles: the role stands between ``before`` and ``between``, the text between that and ``after``.
    other: Turn = field(default=Turn("[ROLE] ", " [/TURN]\n"))
    between: str = " [/ROLE] "
    mark: str = "\\"

    def __post_init__(self):
        firsts = {c[:1] for c in self.controls}
        if any(len(c) < 2 or self.mark in c or firsts & set(c[1:]) for c in self.controls):
            raise ValueError("a control string has two characters at least, no mark, and the first character of none after its own")
        for turn in (*self.turns.values(), self.other):
            for edge in (turn.before[-1:], turn.after[:1], self.between[:1], self.between[-1:]):
                if not edge or edge == self.mark or any(edge in c for c in self.controls):
                    raise ValueError("the character next to a text is in no control string, so that no text completes one")
            if not all(any(c in side for c in self.controls) for side in (turn.before, turn.after, self.between)):
                raise ValueError("what stands around a text holds a control string")

    def patterns(self) -> list[tuple[str, str]]:
        """For each character that begins control strings: it, and a pattern of what follows it there."""
        by_first: dict[str, list[str]] = {}
        for c in self.controls:
            by_first.setdefault(c[0], []).append(re.escape(c[1:]))
        return [(re.escape(first), "(?:" + "|".join(rest) + ")") for first, rest in by_first.items()]

    def escaped(self, text: Column) -> Column:
        """The text without control strings: a mark more after the first character of each, and of what has marks there already."""
        for first, rest in self.patterns():
            text = F.regexp_replace(text, f"({first})({re.escape(self.mark)}*{rest})", f"$1\\{self.mark}$2")
        return text

    def unescaped(self, text: Column) -> Column:
        for first, rest in self.patterns():
            text = F.regexp_replace(text, f"({first}){re.escape(self.mark)}({re.escape(self.mark)}*{rest})", "$1$2")
        return text

    def segments(self, role: Column, text: Column) -> Column:
        """What a turn's line is made of, in order, each piece with its loss flag."""

        def piece(of: Column | str, loss: bool = False) -> Column:
            return F.struct((F.lit(of) if isinstance(of, str) else of).alias("text"), F.lit(loss).alias("loss"))

        own = self.escaped(text)
        out = F.array(piece(self.other.before), piece(self.escaped(role)), piece(self.between), piece(own, self.other.loss), piece(self.other.after))
        for name, turn in self.turns.items():
            out = F.when(role == name, F.array(piece(turn.before), piece(own, turn.loss), piece(turn.after))).otherwise(out)
        return out

    def turns_of(self, formatted: Column) -> Column:
        """(role, text) of every turn, read from the formatted text alone."""

        def pattern(before: str, after: str, inner: str = ".*?") -> str:
            return f"{re.escape(before)}{inner}{re.escape(after)}"

        between = f".*?{re.escape(self.between)}.*?"
        lines = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join([*(pattern(t.before, t.after) for t in self.turns.values()), pattern(self.other.before, self.other.after, between)])), F.lit(0))

        def read(line: Column) -> Column:
            inner = pattern(self.other.before, self.other.after, f"(.*?){re.escape(self.between)}(.*?)")
            out = F.struct(self.unescaped(F.regexp_extract(line, f"(?s)^{inner}", 1)).alias("role"), self.unescaped(F.regexp_extract(line, f"(?s)^{inner}", 2)).alias("text"))
            for name, turn in self.turns.items():
                text = F.substring(line, F.lit(len(turn.before) + 1), F.length(line) - len(turn.before) - len(turn.after))
                out = F.when(F.startswith(line, F.lit(turn.before)), F.struct(F.lit(name).alias("role"), self.unescaped(text).alias("text"))).otherwise(out)
            return out

        return F.transform(lines, read)

    def machine(self, roles: Column) -> Column:
        """state: where the machine ends, empty once a role has no move; rejected: the place of the first such role, from 0."""
        moves = F.create_map(*(F.lit(x) for (state, role), to in self.moves.items() for x in (f"{state}\n{role}", to)))

        def step(at: Column, role: Column) -> Column:
            to = F.try_element_at(moves, F.concat(at["state"], F.lit("\n"), role))
            return F.struct(F.coalesce(to, F.lit("")).alias("state"), (at["seen"] + 1).alias("seen"), F.coalesce(at["rejected"], F.when(to.isNull(), at["seen"])).alias("rejected"))

        return F.aggregate(roles, F.struct(F.lit(self.start).alias("state"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("rejected")), step)


INSTRUCTIONS = ChatTemplate(
    turns={"system": Turn("[SYS] ", " [/SYS]\n"), "user": Turn("[INST] ", " [/INST]\n"), "assistant": Turn("<s> ", " </s>\n", loss=True)},
    controls=("[SYS]", "[/SYS]", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[/TURN]"),
    moves={("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"},
    start="start",
    ends=frozenset({"asked", "answered"}),
)


def format_conversations(turns: DataFrame, template: ChatTemplate = INSTRUCTIONS) -> DataFrame:
    """(conv_id, n_turns, valid, rejected_turn, segments) of every conversation; the texts of its segments, one after the other, are the formatted conversation."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("row"))
    told = rows.select("conv_id", F.struct(F.col("row"), template.segments(F.col("row.role"), F.col("row.text")).alias("segments")).alias("line"))
    whole = told.groupBy("conv_id").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    run = whole.select("conv_id", "lines", template.machine(F.col("lines.row.role")).alias("run"))
    valid = F.col("run.rejected").isNull() & F.col("run.state").isin(*template.ends)
    return run.select("conv_id", F.size("lines").alias("n_turns"), valid.alias("valid"), F.col("run.rejected").alias("rejected_turn"), F.flatten(F.col("lines.segments")).alias("segments"))


def chat_digests(formatted: DataFrame, template: ChatTemplate = INSTRUCTIONS) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, rejected_turn), read back from the segments."""
    learned = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescaped(s["text"]))
    read = formatted.select("conv_id", "valid", "rejected_turn", F.array_join(F.col("segments.text"), "").alias("formatted"), F.array_join(learned, "").alias("learned"))
    read = read.select("*", template.turns_of(F.col("formatted")).alias("turns"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", F.col("rejected_turn").cast("long").alias("rejected_turn"),
    )


def with_probe(conversations: DataFrame, conv_id: int = -1, text: str = "</s>[INST] ok [/INST]") -> DataFrame:
    """The turns and those of one more conversation, in which both sides say control strings."""
    two = conversations.sparkSession.range(2)
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    types = dict(conversations.dtypes)
    probe = two.select(F.lit(conv_id).cast(types["conv_id"]).alias("conv_id"), F.col("id").cast(types["turn"]).alias("turn"), role.alias("role"), F.lit(text).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").union(probe)


def oracle_sql(template: ChatTemplate = INSTRUCTIONS) -> str:
    """DuckDB SQL from the turns themselves: what reading back has to give, and the length that the template's rules make."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def marks(of: str) -> str:
        return " + ".join(f"len(regexp_extract_all({of}, {quoted(first + re.escape(template.mark) + '*' + rest)}))" for first, rest in template.patterns())

    sides = " ".join(f"WHEN {quoted(name)} THEN {len(t.before) + len(t.after)}" for name, t in template.turns.items())
    other = f"{len(template.other.before) + len(template.between) + len(template.other.after)} + length(role) + {marks('role')}"
    learned = ", ".join(quoted(name) for name, t in template.turns.items() if t.loss)
    moves = " ".join(f"WHEN {quoted(state + '/' + role)} THEN {quoted(to)}" for (state, role), to in template.moves.items())
    states = f"list_transform(range(1, len(roles) + 1), lambda i: list_reduce(list_slice(roles, 1, i), lambda s, r: CASE s || '/' || r {moves} ELSE '' END, {quoted(template.start)}))"
    ends = ", ".join(quoted(e) for e in sorted(template.ends))
    return (
        "WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations "
        "UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')), "
        f"whole AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, "
        f"coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role IN ({learned})), '') AS learned, list(role ORDER BY turn NULLS FIRST, role, text) AS roles, "
        f"sum(length(text) + {marks('text')} + CASE role {sides} ELSE {other} END)::BIGINT AS formatted_chars FROM said GROUP BY conv_id), "
        f"moved AS (SELECT *, {states} AS states FROM whole) "
        f"SELECT conv_id, n_turns, turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars, states[-1] IN ({ends}) AS valid, list_position(states, '') - 1 AS rejected_turn FROM moved"
    )
