"""Chat formatting (6), native: a role automaton, a declarative template, loss flags per segment.

A conversation is one row; its turns are sorted by (turn, role, text). Control strings all start
with the template's ``lead``, so escaping is local: each backslash is doubled, and a lead in a text
or role gets a backslash after its first character. Read from the left, a backslash always belongs
to the character after it, so ``unescaped`` takes each backslash out and keeps what follows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own, table


@dataclass(frozen=True)
class Template:
    """Each turn becomes turn + role + text + text-of-turn + end. All three strings start with ``lead``.

    ``lead`` has two characters or more, its first one occurs in it once, and it holds no backslash.
    """

    lead: str = "<|"
    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; what is missing is a violation and leads to the role's own state.
    moves: dict = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user", "tool": "tool"},
            "tool": {"assistant": "assistant"},
        }
    )
    finals: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if len(self.lead) < 2 or self.lead.count(self.lead[0]) > 1 or "\\" in self.lead:
            raise ValueError("lead needs two characters or more, the first only once, and no backslash")
        controls = (self.turn, self.text, self.end)
        if len(set(controls)) < 3 or any(not c.startswith(self.lead) or c.count(self.lead) > 1 or "\\" in c for c in controls):
            raise ValueError("control strings differ, start with lead, hold it once and hold no backslash")
        if any(a != b and (a.startswith(b) or b in a) for a in controls for b in controls):
            raise ValueError("no control string may hold another")

    def escaped(self, text: Column) -> Column:
        doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        return F.replace(doubled, F.lit(self.lead), F.lit(self.lead[0] + "\\" + self.lead[1:]))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def walked(roles: Column, template: Template) -> Column:
    """Run the automaton: struct(state, violations)."""
    table_of = F.create_map(*[F.lit(x) for s, row in template.moves.items() for r, to in row.items() for x in (f"{s}\n{r}", to)])

    def step(state: Column, role: Column) -> Column:
        to = table_of[F.concat(state["state"], F.lit("\n"), role)]
        return F.struct(F.coalesce(to, role).alias("state"), (state["violations"] + to.isNull().cast("long")).alias("violations"))

    return F.aggregate(roles, F.struct(F.lit("start").alias("state"), F.lit(0).cast("long").alias("violations")), step)


def format_chats(df: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv``, formatted, segments array<struct<text, loss>>, valid, violations.

    Null texts and roles count as empty strings, null turns come first, a null conversation id is a
    conversation of its own; repeated rows are repeated turns; ties on turn are ordered by role, then
    text. ``valid``: the automaton saw no violation and ended in a final state; rows are formatted
    either way. An empty table gives no rows. Extra columns of ``df`` are not read. A conversation, being one string, must fit a
    row: it is the unit of output here.
    """
    item = F.struct(own(df, turn).alias("turn"), F.coalesce(own(df, role), F.lit("")).alias("role"), F.coalesce(own(df, text), F.lit("")).alias("text"))
    chats = df.select(own(df, conv).alias("conv"), item.alias("item")).groupBy("conv").agg(F.sort_array(F.collect_list("item")).alias("turns"))
    lit = lambda s, loss=False: F.struct(F.lit(s).alias("text"), F.lit(loss).alias("loss"))
    piece = lambda c, loss: F.struct(template.escaped(c).alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform("turns", lambda t: F.array(lit(template.turn), piece(t["role"], F.lit(False)), lit(template.text), piece(t["text"], t["role"].isin(*template.loss_roles)), lit(template.end)))
    )
    chats = chats.select("conv", segments.alias("segments"), walked(F.transform("turns", lambda t: t["role"]), template).alias("walk"))
    return chats.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        (F.col("walk.state").isin(*template.finals) & (F.col("walk.violations") == 0)).alias("valid"),
        F.col("walk.violations").alias("violations"),
    )


def parsed(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    raw = F.split(formatted, _quoted(template.end), -1)
    turns = F.transform(F.slice(raw, 1, F.size(raw) - 1), lambda t: F.split(F.substr(t, F.lit(len(template.turn) + 1)), _quoted(template.text), 2))
    return F.transform(turns, lambda t: F.struct(unescaped(t[0]).alias("role"), unescaped(t[1]).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def op6_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(extra).alias("text"))
    chats = format_chats(rows.unionByName(more))
    read = chats.select("*", parsed(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "violations",
    )
