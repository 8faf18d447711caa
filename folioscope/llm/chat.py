"""Chat formatting by a finite-state machine over roles, with DataFrame functions only.

``Template`` declares for each role the text around a turn and whether the turn's own text is
trained on.  A conversation's turns, in order of (turn, role, text), become segments with loss
flags; their concatenation is the formatted text.  Inside texts a backslash becomes two and every
control string gets a backslash after its first character, which ``read_back`` undoes, so any text
survives and none can pose as markup.  The control strings are those that the template's frames are made of; each must
have two characters besides white space at least, or the template is refused.  A null text is empty, a null role is ''.
Roles that the template doesn't know are framed with their name.  Repeated rows are turns of their own; turns that
are equal in (turn, role, text) can't be told apart.

The machine starts in ``start``; a turn without a transition leads to ``error`` and stays there.
Conversations that break the order, or end in a state that isn't final, are formatted too; ``valid``
and ``first_error`` (position of the first turn without a transition, from 0) tell.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    #: role: (before, after, whether its text is under the loss)
    roles: dict = field(
        default_factory=lambda: {
            "system": ("[SYS] ", " [/SYS]", False),
            "user": ("[INST] ", " [/INST]", False),
            "assistant": ("<s> ", " </s>", True),
            "tool": ("[TOOL] ", " [/TOOL]", False),
        }
    )
    other: tuple = ("[ROLE ", "] ", " [/ROLE]")
    #: (state, role): state
    transitions: dict = field(
        default_factory=lambda: {
            ("start", "system"): "ready",
            ("start", "user"): "asked",
            ("ready", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
            ("answered", "tool"): "asked",
        }
    )
    final: tuple = ("answered",)


DEFAULT = Template()


def control(template: Template) -> str:
    """Where a text needs a backslash, as a pattern: after the first character of a control string.

    Control strings are what frames begin and end with, without white space around.
    """
    strings = [x.strip() for before, after, _ in template.roles.values() for x in (before, after)]
    strings += [template.other[0].strip(), template.other[2].strip()]
    if any(len(x) < 2 or "\\" in x for x in strings) or not template.other[1]:
        raise ValueError("every string around a turn needs two characters besides white space, and no backslash")
    return "|".join(f"(?<={_quote(x[0])})(?={_quote(x[1:])})" for x in sorted(set(strings)))


def escape(text: Column, template: Template = DEFAULT) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), control(template), r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _quote(text: str) -> str:
    return "".join("\\" + c if c in r"\[](){}.*+?^$|/" else c for c in text)


def _segments(turn: Column, template: Template) -> Column:
    role, text = turn["role"], escape(turn["text"], template)

    def three(before: Column, after: Column, loss: bool) -> Column:
        return F.array(*[F.struct(x.alias("text"), F.lit(f).alias("loss")) for x, f in ((before, False), (text, loss), (after, False))])

    name, end, after = template.other
    out = three(F.concat(F.lit(name), F.replace(escape(role, template), F.lit(end[0]), F.lit("\\" + end[0])), F.lit(end)), F.lit(after), False)
    for known, (before, after, loss) in template.roles.items():
        out = F.when(role == known, three(F.lit(before), F.lit(after), loss)).otherwise(out)
    return out


def _run(turns: Column, template: Template) -> Column:
    """(state, first_error) after the turns."""
    nothing = F.struct(F.lit("start").alias("state"), F.lit(None).cast("int").alias("first_error"), F.lit(0).alias("i"))
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.transitions.items() for x in (f"{state} {role}", to)])

    def step(acc: Column, turn: Column) -> Column:
        to = F.coalesce(F.try_element_at(moves, F.concat(acc["state"], F.lit(" "), turn["role"])), F.lit("error"))
        error = F.when((to == "error") & acc["first_error"].isNull(), acc["i"]).otherwise(acc["first_error"])
        return F.struct(to.alias("state"), error.alias("first_error"), (acc["i"] + 1).alias("i"))

    return F.aggregate(turns, nothing, step)


def format_conversations(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """A row for each conversation of (conv_id, turn, role, text): conv_id, segments, formatted, valid, first_error."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    out = out.select("conv_id", F.flatten(F.transform("turns", lambda t: _segments(t, template))).alias("segments"), _run(F.col("turns"), template).alias("end"))
    return out.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("end.state").isin(*template.final) & F.col("end.first_error").isNull()).alias("valid"),
        F.col("end.first_error").alias("first_error"),
    )


def read_back(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns (role, text) of a formatted text, unescaped."""
    name, end, after = map(_quote, template.other)
    other = _quote(template.other[1][0])
    label = rf"{name}([^\\{other}]*+(?:\\.[^\\{other}]*+)*+){end}"
    frames = [f"{_quote(b)}.*?{_quote(a)}" for b, a, _ in template.roles.values()] + [f"{label}.*?{after}"]
    turns = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(frames)), F.lit(0))

    def turn(x: Column) -> Column:
        begin = F.length(F.regexp_extract(x, f"(?s)^{label}", 0))
        out = F.struct(unescape(F.regexp_extract(x, f"(?s)^{label}", 1)).alias("role"), unescape(x.substr(begin + 1, F.length(x) - begin - len(template.other[2]))).alias("text"))
        for role, (before, behind, _) in template.roles.items():
            own = F.struct(F.lit(role).alias("role"), unescape(x.substr(F.lit(len(before) + 1), F.length(x) - len(before) - len(behind))).alias("text"))
            out = F.when(x.startswith(before), own).otherwise(out)
        return out

    return F.transform(turns, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, one after the other."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
