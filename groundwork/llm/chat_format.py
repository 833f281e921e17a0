"""Chat formatting (operator 11): a declarative template, a state machine over roles, loss flags by segment.

Everything is a column expression: a conversation's rows are gathered in turn order, a fold over
their roles walks the machine, each turn becomes three segments (what opens it, its text, what
closes it) with a loss flag each, and the segments joined are the formatted text. ``read_back``
takes a formatted text apart again with the template alone.

Control strings inside a text get the escape character behind their first character, escape
characters are doubled; so no control string stands in an escaped text, and the way back is exact.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    """How a role's turn is written. `loss` flags its text, `loss_close` what closes it, as to be learnt."""

    opens: str
    closes: str
    loss: bool = False
    loss_close: bool = False


@dataclass(frozen=True)
class Template:
    """The marks of the roles, the machine's moves and where it may end.

    `turns` has the known roles; any other role is written by `other`, its name before the mark
    `named`. `moves` maps (state, role) to the next state; a role without a move from the present
    state breaks the order. What closes a turn must tell its role, so all of these differ.
    """

    begin: str
    turns: dict[str, Turn]
    other: Turn
    named: str
    moves: dict[tuple[str, str], str]
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    escape: str = "\\"

    def __post_init__(self) -> None:
        marks = self.controls
        leads = {m[0] for m in marks}
        closes = [t.closes for t in (*self.turns.values(), self.other)]
        if len(self.escape) != 1 or any(self.escape in m for m in marks):
            raise ValueError("the escape is one character that no control string holds")
        if any(lead in m[1:] for m in marks for lead in leads) or any(len(m) < 2 for m in marks):
            raise ValueError("a control string's first character may stand nowhere else in a control string")
        if any(a != b and b.startswith(a) for a in marks for b in marks) or len({*closes}) < len(closes) or not all(closes) or not self.named:
            raise ValueError("every turn is closed by a control string of its own, none of which begins another")

    @property
    def controls(self) -> list[str]:
        """All control strings, each once."""
        marks = [self.begin, self.named, *(m for t in (*self.turns.values(), self.other) for m in (t.opens, t.closes))]
        return [m for m in dict.fromkeys(marks) if m]


#: A bracket template with the reply outside brackets.
BRACKETS = Template(
    begin="<s>",
    turns={"system": Turn("[SYS]", "[/SYS]"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("", "</s>", loss=True)},
    other=Turn("[ROLE]", "[/ROLE]"),
    named="[SAYS]",
    moves={
        ("start", "system"): "instructed",
        ("start", "user"): "asked",
        ("instructed", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    },
)


def escaped(text: Column, template: Template = BRACKETS) -> Column:
    """text without any control string in it."""
    inside = "|".join(f"(?<={re.escape(m[0])})(?={re.escape(m[1:])})" for m in template.controls)
    doubled = F.replace(text, F.lit(template.escape), F.lit(template.escape * 2))
    return F.regexp_replace(doubled, inside, re.escape(template.escape))


def unescaped(text: Column, template: Template = BRACKETS) -> Column:
    """The text that `escaped` was given."""
    by_lead = "|".join(f"(?<={re.escape(m[0])}){re.escape(template.escape)}(?={re.escape(m[1:])})" for m in template.controls)
    return F.replace(F.regexp_replace(text, by_lead, ""), F.lit(template.escape * 2), F.lit(template.escape))


def _by_role(role: Column, template: Template, value) -> Column:
    """value(turn) of the role's turn in the template, a literal."""
    chosen = F
    for name, turn in template.turns.items():
        chosen = chosen.when(role == name, F.lit(value(turn)))
    return chosen.otherwise(F.lit(value(template.other))) if template.turns else F.lit(value(template.other))


def walk(roles: Column, template: Template = BRACKETS) -> Column:
    """Struct of the state after all roles and the place (from 0) of the first that had no move, -1 if none."""

    def move(now: Column, role: Column) -> Column:
        state = F
        for (before, named), after in template.moves.items():
            state = state.when((now["state"] == before) & (role == named), F.lit(after))
        state = state.otherwise(F.lit("broken")) if template.moves else F.lit("broken")
        bad = F.when(now["bad"] >= 0, now["bad"]).when(state == "broken", now["at"]).otherwise(F.lit(-1))
        return F.struct(state.alias("state"), bad.alias("bad"), (now["at"] + 1).alias("at"))

    return F.aggregate(roles, F.struct(F.lit(template.start).alias("state"), F.lit(-1).alias("bad"), F.lit(0).alias("at")), move)


def segments(turns: Column, template: Template = BRACKETS) -> Column:
    """Array of structs (text, loss) of an array of turns (role, text): the begin mark, then three for each turn."""

    def parts(t: Column) -> Column:
        known = t["role"].isin(*template.turns)
        opens = F.concat(_by_role(t["role"], template, lambda x: x.opens), F.when(known, F.lit("")).otherwise(F.concat(escaped(t["role"], template), F.lit(template.named))))
        flags = [F.lit(False), _by_role(t["role"], template, lambda x: x.loss), _by_role(t["role"], template, lambda x: x.loss_close)]
        texts = [opens, escaped(t["text"], template), _by_role(t["role"], template, lambda x: x.closes)]
        return F.array(*(F.struct(text.alias("text"), loss.alias("loss")) for text, loss in zip(texts, flags, strict=True)))

    begin = F.array(F.struct(F.lit(template.begin).alias("text"), F.lit(False).alias("loss")))
    return F.concat(begin, F.flatten(F.transform(turns, parts)))


def format_chats(rows: DataFrame, template: Template = BRACKETS) -> DataFrame:
    """conv_id, n_turns, state, bad_turn, valid, segments and formatted text of every conversation.

    Turns go by turn number, null first; rows of the same number by role, then text, and repeated
    rows are turns of their own. A null text or role is empty, a null conv_id a conversation of its
    own. Order: `bad_turn` is the place of the first turn that the machine has no move for (-1 if
    none), `valid` tells that there is none and the machine stopped in a final state; others are
    formatted all the same. An empty table gives an empty result; other columns are not read.
    A conversation is one row of the result, so one task gathers it.
    """
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    end = walk(F.transform("turns", lambda t: t["role"]), template)
    return (
        found.select("conv_id", F.size("turns").cast("long").alias("n_turns"), end.alias("end"), segments(F.col("turns"), template).alias("segments"))
        .select(
            "conv_id", "n_turns", F.col("end.state").alias("state"), F.col("end.bad").alias("bad_turn"),
            ((F.col("end.bad") < 0) & F.col("end.state").isin(*template.final)).alias("valid"), "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        )
    )


def read_back(formatted: Column, template: Template = BRACKETS) -> Column:
    """Array of structs (role, text, loss) of a formatted text's turns, escapes undone.

    A turn ends where a closing mark stands, which tells its role; marks stand nowhere else.
    """
    closes = "|".join(re.escape(t.closes) for t in (*template.turns.values(), template.other))
    body = F.substring(formatted, F.lit(len(template.begin) + 1), F.length(formatted))
    pieces = F.regexp_extract_all(body, F.lit(f"(?s).*?(?:{closes})"), F.lit(0))

    def turn(piece: Column) -> Column:
        def inner(t: Turn) -> Column:
            return F.substring(piece, F.lit(len(t.opens) + 1), F.length(piece) - len(t.opens) - len(t.closes))

        named = F.split(inner(template.other), re.escape(template.named), 2)
        role, text, loss = F, F, F
        for name, t in template.turns.items():
            here = piece.endswith(t.closes)
            role, text, loss = role.when(here, F.lit(name)), text.when(here, inner(t)), loss.when(here, F.lit(t.loss))
        return F.struct(
            (role.otherwise(unescaped(named[0], template)) if template.turns else unescaped(named[0], template)).alias("role"),
            unescaped(text.otherwise(named[1]) if template.turns else named[1], template).alias("text"),
            (loss.otherwise(F.lit(template.other.loss)) if template.turns else F.lit(template.other.loss)).alias("loss"),
        )

    return F.transform(pieces, turn)


def chat_digests(chats: DataFrame, template: Template = BRACKETS) -> DataFrame:
    """Digests of formatted conversations, all read back from formatted texts and flagged segments.

    conv_id, n_turns, turns_sha256 (role, line break, text, line break of every turn), loss_chars and
    loss_sha256 (code points and digest of the flagged texts, unescaped), formatted_chars, valid.
    """
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", read_back(F.col("formatted"), template).alias("turns"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"), "valid").select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt"), 256).alias("loss_sha256"), "formatted_chars", "valid",
    )
