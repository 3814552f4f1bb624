"""Chat formatting whose output can be read back exactly.

Grammar of a formatted conversation, in control strings and text without any:

    conversation := turn*
    turn := "<s>" role open text "</s>"
    open := "[INST]" | "[/INST]" | "[INST*]" | "[/INST*]"

``[/INST]`` opens text under the loss mask (of the assistant), ``[INST]`` any other; with a star, the text is escaped: a
backslash stands before the second character of every control string and before every backslash. Roles are escaped
always.

Each turn is rendered as it is and parsed again; if the parser does not give back the same turn, its text holds a control
string, and the turn is rendered escaped. The whole conversation is then parsed and compared with its source. If it were
still different, all turns would be escaped; if that were different too, the query fails, so no output that cannot be
read back is ever returned.

All of it is column expressions. A conversation is one string, so its turns meet in one task, as the output demands;
nothing else does.

Edge cases: null roles and texts are empty; turns of one conversation are ordered by turn (null first), then role and
text; repeated rows are repeated turns; a null conversation id is a conversation; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings, and others of the same family that no text may show unescaped.
TURN, END = "<s>", "</s>"
PLAIN, LOSS, PLAIN_ESCAPED, LOSS_ESCAPED = "[INST]", "[/INST]", "[INST*]", "[/INST*]"
OTHERS = ("<<SYS>>", "<</SYS>>")
CONTROL = (TURN, END, PLAIN, LOSS, PLAIN_ESCAPED, LOSS_ESCAPED, *OTHERS)
_ANY = "|".join(re.escape(c) for c in CONTROL)


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}")), CONTROL, doubled)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(role: Column, text: Column, escaped: bool, loss_role: str = "assistant") -> Column:
    """One turn."""
    marks = (LOSS_ESCAPED, PLAIN_ESCAPED) if escaped else (LOSS, PLAIN)
    mark = F.when(role == loss_role, marks[0]).otherwise(marks[1])
    return F.concat(F.lit(TURN), escape(role), mark, escape(text) if escaped else text, F.lit(END))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, also where ``then`` uses it for each element of an array."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def parse(rendered: Column) -> Column:
    """Array of (role, text, loss) of a rendered conversation; null if it does not follow the grammar."""
    marks = F.regexp_extract_all(rendered, F.lit(f"({_ANY})"), F.lit(1))
    split = F.struct(marks.alias("marks"), F.split(rendered, _ANY, -1).alias("texts"))
    return _once(split, _turns)


def _turns(split: Column) -> Column:
    marks, texts = split["marks"], split["texts"]
    n = (F.size(marks) / 3).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    opens = F.array(*[F.lit(x) for x in (PLAIN, LOSS, PLAIN_ESCAPED, LOSS_ESCAPED)])

    def follows(i: Column) -> Column:
        return (
            (F.get(marks, i * 3) == TURN)
            & F.array_contains(opens, F.get(marks, i * 3 + 1))
            & (F.get(marks, i * 3 + 2) == END)
            & (F.get(texts, i * 3) == "")
        )

    def turn(i: Column) -> Column:
        mark, body = F.get(marks, i * 3 + 1), F.get(texts, i * 3 + 2)
        return F.struct(
            unescape(F.get(texts, i * 3 + 1)).alias("role"),
            F.when(mark.isin(PLAIN_ESCAPED, LOSS_ESCAPED), unescape(body)).otherwise(body).alias("text"),
            mark.isin(LOSS, LOSS_ESCAPED).alias("loss"),
        )

    whole = (F.size(marks) == n * 3) & (F.get(texts, n * 3) == "") & F.forall(places, follows)
    return F.when(whole, F.transform(places, turn))


def format_conversations(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """(conversation id, formatted, turns): the output, and what the parser reads back from it."""
    plain = rows.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    role, text = F.col("role"), F.col("text")
    own = F.array(F.struct("role", "text", (role == loss_role).alias("loss")))
    rendered = plain.withColumn("raw", render(role, text, False, loss_role))
    rendered = rendered.withColumn("identical", F.coalesce(parse(F.col("raw")) == own, F.lit(False)))
    rendered = rendered.withColumn("piece", F.when(F.col("identical"), F.col("raw")).otherwise(render(role, text, True, loss_role)))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "piece"))).alias("source")
    grouped = rendered.groupBy("conv").agg(turns)

    def source(t: Column) -> Column:
        return F.struct(t["role"].alias("role"), t["text"].alias("text"), (t["role"] == loss_role).alias("loss"))

    wanted = F.transform("source", source)
    whole = grouped.select("conv", "source", F.array_join("source.piece", "").alias("formatted"))
    read = whole.withColumn("turns", parse(F.col("formatted")))
    good = F.coalesce(F.col("turns") == wanted, F.lit(False))
    all_escaped = F.array_join(F.transform("source", lambda t: render(t["role"], t["text"], True, loss_role)), "")
    again = read.withColumn("formatted", F.when(good, F.col("formatted")).otherwise(all_escaped))
    again = again.withColumn("turns", F.when(good, F.col("turns")).otherwise(parse(F.col("formatted"))))
    failed = F.raise_error(F.lit("a conversation cannot be read back")).cast("string")
    checked = F.when(F.coalesce(F.col("turns") == wanted, F.lit(False)), F.col("formatted")).otherwise(failed)
    return again.select(F.col("conv").alias(conv_col), checked.alias("formatted"), "turns")


def loss_text(turns: Column) -> Column:
    """The text under the loss mask: the assistant's texts in order, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["loss"]), lambda t: t["text"]), "")
