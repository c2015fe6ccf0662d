"""Operator 4: chat formatting from a declarative template. DataFrame functions only.

A finite-state machine over the roles checks the order of turns; the formatter
emits text segments, each with a flag that says whether it counts in the loss.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What marks a turn, which roles are learned and which orders of roles are valid.

    ``controls`` maps each control string to the code that replaces it inside texts,
    after a backslash. The backslash itself becomes ``\\b``, so every backslash of an
    escaped text starts exactly one code and unescaping is unambiguous.
    """

    header: str = "### {role}: "
    footer: str = "</turn>\n"
    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss_roles: tuple[str, ...] = ("assistant",)
    controls: dict[str, str] = field(default_factory=lambda: {"###": "h", "</turn>": "t"})
    #: state -> role -> next state
    transitions: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accepting: tuple[str, ...] = ("answered",)
    #: the state to go on from after a turn that no transition allows
    recovery: dict[str, str] = field(default_factory=lambda: {"system": "told", "user": "asked", "assistant": "answered"})

    def escape(self, text: Column) -> Column:
        out = F.replace(text, F.lit("\\"), F.lit("\\b"))
        for control, code in self.controls.items():
            out = F.replace(out, F.lit(control), F.lit("\\" + code))
        return out

    def unescape(self, text: Column) -> Column:
        out = text
        for control, code in self.controls.items():
            out = F.replace(out, F.lit("\\" + code), F.lit(control))
        return F.replace(out, F.lit("\\b"), F.lit("\\"))

    def label(self, role: Column) -> Column:
        """Roles without a label get ``~`` and their escaped name; a null role is ``-``."""
        known = F.create_map(*[F.lit(x) for pair in self.labels.items() for x in pair])
        other = F.concat(F.lit("~"), F.replace(self.escape(role), F.lit(":"), F.lit("\\c")))
        return F.coalesce(F.try_element_at(known, role), other, F.lit("-"))

    def role(self, label: Column) -> Column:
        known = F.create_map(*[F.lit(x) for role, name in self.labels.items() for x in (name, role)])
        other = self.unescape(F.replace(F.substring(label, 2, 2**30), F.lit("\\c"), F.lit(":")))
        return F.coalesce(F.try_element_at(known, label), F.when(label.startswith("~"), other))


def _run_machine(turns: Column, template: Template) -> Column:
    """The last state and the number of turns that no transition allows."""
    moves = F.create_map(*[F.lit(x) for s, by in template.transitions.items() for r, n in by.items() for x in (f"{s}>{r}", n)])
    recover = F.create_map(*[F.lit(x) for pair in template.recovery.items() for x in pair])

    def step(at: Column, turn: Column) -> Column:
        to = F.try_element_at(moves, F.concat(at["state"], F.lit(">"), F.coalesce(turn["role"], F.lit(""))))
        return F.struct(
            F.coalesce(to, F.try_element_at(recover, F.coalesce(turn["role"], F.lit(""))), at["state"]).alias("state"),
            (at["bad"] + F.when(to.isNull(), 1).otherwise(0)).alias("bad"),
        )

    return F.aggregate(turns, F.struct(F.lit("start").alias("state"), F.lit(0).alias("bad")), step)


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row a conversation: conv_id, valid, invalid_turns, segments (text, loss), formatted.

    ``turns`` has conv_id, turn, role, text; other columns are not read. Turns are
    ordered by turn, then role and text; a null turn comes last, a null text is
    empty, a null role stays null. Repeated rows are turns of their own. Rows
    with a null conv_id form one conversation. Every conversation is formatted;
    ``valid`` says whether the machine accepts it. Empty tables give no rows.
    A conversation is one output text, so its turns meet in one row.
    """
    template = template or Template()
    before, after = (F.lit(x) for x in template.header.split("{role}"))
    header = F.concat(before, template.label(F.col("role")), after)
    turn = F.struct(
        F.col("turn").isNull().alias("last"), "turn", F.col("role").isNull().alias("no_role"), "role",
        F.coalesce("text", F.lit("")).alias("raw"), header.alias("header"),
    )
    ordered = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        learn = F.coalesce(t["role"].isin(*template.loss_roles), F.lit(False))
        one = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(one(t["header"], F.lit(False)), one(template.escape(t["raw"]), learn), one(F.lit(template.footer), F.lit(False)))

    out = ordered.select("conv_id", _run_machine(F.col("turns"), template).alias("end"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return out.select(
        "conv_id",
        ((F.col("end.bad") == 0) & F.col("end.state").isin(*template.accepting)).alias("valid"),
        F.col("end.bad").alias("invalid_turns"),
        "segments",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
    )


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """``formatted`` with turns (role, text) parsed from the formatted text, and loss_text from the flagged segments."""
    template = template or Template()
    before, after = template.header.split("{role}")
    pieces = F.split("formatted", "\\Q" + template.footer + "\\E")

    def parse(piece: Column) -> Column:
        rest = F.substring(piece, len(before) + 1, 2**30)
        label = F.substring_index(rest, after, 1)
        text = F.substring(rest, F.char_length(label) + F.lit(len(after) + 1), F.lit(2**30))
        return F.struct(template.role(label).alias("role"), template.unescape(text).alias("text"))

    learned = F.filter("segments", lambda s: s["loss"])
    return formatted.withColumn("turns", F.transform(F.slice(pieces, 1, F.size(pieces) - 1), parse)).withColumn(
        "loss_text", F.array_join(F.transform(learned, lambda s: template.unescape(s["text"])), "")
    )
