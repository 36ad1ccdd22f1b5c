"""Chat formatting: a state machine over roles checks the order of turns, a declarative template gives the
text segments of each turn with a loss flag per segment. DataFrame functions only.

A template's control strings are escaped inside texts, so the formatted text can be read back: '%' becomes
'%25', and the first character of a control string becomes its code ('<' '%3C', '[' '%5B')."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands around a turn, which roles are learned, and which role may follow which.

    bos and eos enclose every turn. marks gives the opening and closing string of a role; other roles get
    named between role_marks. transitions: state -> role -> next state; a role that is not listed leads to 'refused', which is left no more."""
    bos: str = "<s>"
    eos: str = "</s>"
    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "[/OUT]")})
    role_marks: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    transitions: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "instructed", "user": "asked"},
        "instructed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"}})
    accepting: tuple[str, ...] = ("answered",)

    @property
    def controls(self) -> list[str]:
        """Longest first, so that none hides another."""
        all_of = [self.bos, self.eos, *self.role_marks, *(m for pair in self.marks.values() for m in pair)]
        return sorted({s for s in all_of if s}, key=lambda s: (-len(s), s))


DEFAULT = Template()
REFUSED = "refused"


def _pattern(strings: list[str]) -> str:
    return "|".join(re.escape(s) for s in strings)


def escape(text: Column, template: Template = DEFAULT) -> Column:
    out = F.replace(text, F.lit("%"), F.lit("%25"))
    for first in sorted({c[0] for c in template.controls}):
        tails = [c[1:] for c in template.controls if c[0] == first]
        out = F.regexp_replace(out, f"{re.escape(first)}(?={_pattern(tails)})", f"%{ord(first):02X}")
    return out


def unescape(text: Column, template: Template = DEFAULT) -> Column:
    out = text
    for first in sorted({c[0] for c in template.controls}):
        out = F.replace(out, F.lit(f"%{ord(first):02X}"), F.lit(first))
    return F.replace(out, F.lit("%25"), F.lit("%"))


def final_state(roles: Column, template: Template = DEFAULT) -> Column:
    """The state after all roles of an array."""
    step = F.create_map(*[F.lit(x) for state, row in template.transitions.items() for role, then in row.items()
                          for x in (f"{state}\n{role}", then)])
    return F.aggregate(roles, F.lit(template.start), lambda s, r: F.coalesce(F.try_element_at(step, F.concat(s, F.lit("\n"), r)), F.lit(REFUSED)))


def _segments(role: Column, text: Column, template: Template) -> Column:
    def part(c: Column, loss: Column) -> Column:
        return F.struct(c.alias("text"), loss.alias("loss"))

    opening = F.concat(F.lit(template.role_marks[0]), escape(role, template), F.lit(template.role_marks[1]))
    closing = F.lit("")
    for name, (a, b) in template.marks.items():
        opening = F.when(role == name, F.lit(a)).otherwise(opening)
        closing = F.when(role == name, F.lit(b)).otherwise(closing)
    no = F.lit(False)
    return F.array(part(F.concat(F.lit(template.bos), opening), no), part(escape(text, template), role.isin(*template.loss_roles)),
                   part(F.concat(closing, F.lit(template.eos)), no))


def format_chats(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, n_turns, state, valid, segments (array of text, loss), formatted.

    Every conversation is formatted, valid or not, and the verdict stands beside it. Null roles and texts count
    as empty; rows are ordered by turn (null first), then role and text, repeated rows all stay; a null conv_id
    is a conversation of its own. A conversation is one document of the output, so its turns meet in one row. Other columns are not
    looked at. An empty table gives no rows."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    state = final_state(F.transform("t", lambda t: t["role"]), template)
    return chats.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), state.alias("state"), state.isin(*template.accepting).alias("valid"),
        F.flatten(F.transform("t", lambda t: _segments(t["role"], t["text"], template))).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: Template = DEFAULT) -> Column:
    """Formatted text -> array of (role, text), unescaped. Control strings only stand where the template put them."""
    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(1), F.char_length(piece) - len(template.eos))
        a, b = template.role_marks
        named = F.split(F.substr(body, F.lit(len(a) + 1)), re.escape(b), 2)
        out = F.struct(unescape(named[0], template).alias("role"), unescape(F.coalesce(F.try_element_at(named, F.lit(2)), F.lit("")), template).alias("text"))
        for name, (a, b) in template.marks.items():
            inner = F.substr(body, F.lit(len(a) + 1), F.char_length(body) - (len(a) + len(b)))
            out = F.when(F.startswith(body, F.lit(a)), F.struct(F.lit(name).alias("role"), unescape(inner, template).alias("text"))).otherwise(out)
        return out

    pieces = F.split(formatted, re.escape(template.bos), -1)
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def loss_text(segments: Column, template: Template = DEFAULT) -> Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
