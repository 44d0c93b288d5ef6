"""Chat formatting: prefix-target expansion.

Each assistant turn becomes an example of its own: all preceding turns are its
context, and the reply's text alone is trainable. Turns after the last reply,
or a conversation without a reply, give one closing example without a target,
so every conversation can be read back from the output. A turn is written

    <|im_start|>role\\ntext<|im_end|>\\n

and texts and roles are escaped so that no control string can occur inside
one: a backslash is doubled, ``<|`` becomes ``<\\|``, and a line end in a role
becomes ``\\n``. ``unescape`` undoes it exactly.

Everything is DataFrame functions. A conversation is one group by nature: its
formatted examples are rows that hold it whole. Turns are sorted by turn, role
and text, nulls first; a repeated turn is kept, in that order. Null roles and
texts are empty; rows with a null conv_id are one conversation. An empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")))
    return F.array_join(plain, "\\")


def expand(turns: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (its number), target (the turn's number, null for a closing
    example), formatted, loss_start and loss_length (code points from 0; 0 and 0 without a target)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    body = escape(F.col("text"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    item = F.struct("turn", F.col("role"), F.col("text"), head.alias("head"), body.alias("body"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("t"))
    whole = whole.select("conv_id", F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))).alias("line"), F.transform("t", lambda x: F.struct((x["role"] == "assistant").alias("own"), F.length(x["head"]).alias("head"), F.length(x["body"]).alias("body"))).alias("m"))
    n = F.size("line")
    own = F.filter(F.transform("m", lambda x, i: F.when(x["own"], i)), lambda i: i.isNotNull())
    last = F.when(F.size(own) > 0, F.array_max(own)).otherwise(F.lit(-1))
    ends = F.concat(F.transform(own, lambda i: F.struct(i.alias("end"), i.alias("target"))), F.when(last < n - 1, F.array(F.struct((n - 1).alias("end"), F.lit(None).cast("int").alias("target")))).otherwise(F.array().cast("array<struct<end:int,target:int>>")))
    out = whole.select("conv_id", "line", "m", F.posexplode(ends).alias("example", "e"))
    before = F.array_join(F.slice("line", F.lit(1), F.col("e.end")), "")
    out = out.select("conv_id", "example", F.col("e.target").alias("target"), before.alias("before"), F.element_at("line", F.col("e.end") + 1).alias("line"), F.element_at("m", F.col("e.end") + 1).alias("m"))
    return out.select(
        "conv_id",
        "example",
        "target",
        F.concat("before", "line").alias("formatted"),
        F.when(F.col("target").isNotNull(), F.length("before") + F.col("m.head")).otherwise(0).cast("long").alias("loss_start"),
        F.when(F.col("target").isNotNull(), F.col("m.body")).otherwise(0).cast("long").alias("loss_length"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted example: array of struct(role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda x: x != "")
    bare = F.transform(pieces, lambda x: F.substring(x, F.lit(1), F.length(x) - len(END) - 1))
    cut = F.transform(bare, lambda x: F.struct(x.alias("x"), F.instr(x, "\n").alias("at")))
    return F.transform(cut, lambda p: F.struct(unescape_role(F.substring(p["x"], F.lit(1), p["at"] - 1)).alias("role"), unescape(F.substring(p["x"], p["at"] + 1, F.length(p["x"]))).alias("text")))


def digest(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from its examples: the longest holds all turns, and each
    example's mask holds one reply."""
    loss = F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length"))
    rows = examples.select("conv_id", "example", "formatted", F.when(F.col("target").isNotNull(), unescape(loss)).otherwise("").alias("loss"))
    rows = rows.withColumn("chars", F.length("formatted").cast("long"))
    sums = rows.groupBy("conv_id").agg(F.max_by("formatted", "example").alias("all"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"), F.sum("chars").alias("formatted_chars"))
    turns = sums.withColumn("t", read_back(F.col("all")))
    spelled = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return turns.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(spelled, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
