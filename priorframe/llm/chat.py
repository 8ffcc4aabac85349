"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of
one role form a block by an array aggregation; blocks are concatenated:

    ### role:\n first text \n<cut/>\n second text \n</turn>\n

Control strings inside texts get one backslash in front, and reading back takes
one away; a control string of the template always follows a line break, so a
text that ends in a backslash can't hide it. Roles have line breaks and
backslashes escaped. The loss mask lists the stretches of assistant texts in
the output, in code points.

Defined cases: null texts and roles are empty; turns sort by turn, role, text,
nulls first; repeated rows are repeated turns; null is a conversation like any
other; an empty table gives an empty result; further columns are ignored. A
conversation is one output string, so it is the one thing held whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"(###|</turn>|<cut/>)"
END, CUT = "\n</turn>\n", "\n<cut/>\n"
ASSISTANT = "assistant"
BLOCK = "array<struct<role:string,texts:array<string>>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + CONTROL, "$1")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def blocks(turns: Column) -> Column:
    """Merge adjacent turns (role, text) of the same role."""
    one = lambda t: F.array(F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts")))

    def step(acc: Column, t: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.array(F.struct(last["role"].alias("role"), F.array_append(last["texts"], t["text"]).alias("texts")))
        return F.when(last["role"] == t["role"], F.concat(F.slice(acc, 1, F.size(acc) - 1), grown)).otherwise(F.concat(acc, one(t)))

    return F.aggregate(turns, F.array().cast(BLOCK), step)


def head(block: Column) -> Column:
    return F.concat(F.lit("### "), escape_role(block["role"]), F.lit(":\n"))


def render(block: Column) -> Column:
    return F.concat(head(block), F.array_join(F.transform(block["texts"], escape), CUT), F.lit(END))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (start and end of every assistant text in it), n_blocks."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    told = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    told = told.select("conv_id", blocks(F.col("turns")).alias("blocks"))
    pieces = F.flatten(F.transform("blocks", lambda b: F.concat(
        F.array(F.struct(F.length(head(b)).alias("n"), F.lit(False).alias("loss"))),
        F.flatten(F.transform(b["texts"], lambda t, i: F.concat(
            F.when(i > 0, F.array(F.struct(F.lit(len(CUT)).alias("n"), F.lit(False).alias("loss")))).otherwise(F.array().cast("array<struct<n:int,loss:boolean>>")),
            F.array(F.struct(F.length(escape(t)).alias("n"), (b["role"] == ASSISTANT).alias("loss"))),
        ))),
        F.array(F.struct(F.lit(len(END)).alias("n"), F.lit(False).alias("loss"))),
    )))
    loss = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + p["n"]).alias("at"),
            F.when(p["loss"], F.array_append(acc["spans"], F.struct(acc["at"].alias("start"), (acc["at"] + p["n"]).alias("end")))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return told.select("conv_id", F.array_join(F.transform("blocks", render), "").alias("formatted"), loss.alias("loss"), F.size("blocks").alias("n_blocks"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    raw = F.filter(F.split(formatted, END, -1), lambda x: x != "")

    def turns(block: Column) -> Column:
        line = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(line) + 2, F.length(block))
        role = unescape_role(F.substring(line, F.lit(5), F.length(line) - 5))
        return F.transform(F.split(body, CUT, -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(raw, turns))


def masked(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))


def digest(chats: DataFrame) -> DataFrame:
    """What format_chats made, read back: counts and digests of turns and of masked text."""
    told = chats.select("*", read_back(F.col("formatted")).alias("turns"), F.array_join(masked(F.col("formatted"), F.col("loss")), "").alias("learnt"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), F.col("n_blocks").cast("long").alias("n_blocks"),
    )
