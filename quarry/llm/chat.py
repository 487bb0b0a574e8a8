"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role become a block by array
functions; blocks are concatenated into the formatted text:

    <|start|>ROLE<|text|>TEXT<|next|>TEXT<|end|> ...

`<|next|>` parts the turns that a block merges, so the original turns can be read back. A control string inside a role
or a text gets one backslash after its first character, and one that already has backslashes there gets one
more, so escaping is one to one; what reads the text back takes one off.

Defined cases: a null text or role is empty; turns sort by turn (nulls first), then role and text, so ties and
repeated rows have a fixed order; a row without a conversation id is a conversation of its own, so such rows never meet in one
task; an empty table gives an empty result; columns other than the four named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import base

START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>"
#: What may not appear in a text as it is: our own marks and those of common templates. Fixed values.
_FIRST, _REST = r"[<\[]", r"\||/?s>|/?INST\]|<SYS>>|</SYS>>"
_PLAIN, _MARKED = rf"({_FIRST})(\\*)({_REST})", rf"({_FIRST})\\(\\*)({_REST})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _MARKED, "$1$2$3")


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, formatted), one row per conversation."""
    row = F.struct(F.col(turn).alias("turn"), escape(F.coalesce(role, F.lit(""))).alias("role"), escape(F.coalesce(text, F.lit(""))).alias("text"))
    rows = turns.select(F.col(conv), F.when(F.col(conv).isNull(), F.monotonically_increasing_id()).alias("_c_alone"), row.alias("_c_row"))
    whole = rows.groupBy(F.col(conv), "_c_alone").agg(F.sort_array(F.collect_list("_c_row")).alias("_c_turns"))
    t = F.col("_c_turns")
    # The positions at which a block starts: where the role differs from the turn before.
    first = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))
    whole = whole.withColumn("_c_first", first)
    starts = F.col("_c_first")

    def block(i: Column, nth: Column) -> Column:
        till = F.coalesce(F.get(starts, nth + 1), F.size(t))
        return F.concat(F.lit(START), F.get(t, i)["role"], F.lit(TEXT), F.array_join(F.transform(F.slice(t, i + 1, till - i), lambda x: x["text"]), NEXT), F.lit(END))

    return whole.select(conv, F.array_join(F.transform(starts, block), "").alias("formatted"))


def read_back(text: Column) -> Column:
    """array<struct<role, text, loss>>: the turns of a formatted text, unescaped; loss: it is an assistant's."""
    blocks = F.slice(F.split(text, r"<\|start\|>"), 2, 1 << 30)  # the first is what stands before the first mark: nothing

    def turns(block: Column) -> Column:
        parts = F.split(F.regexp_replace(block, r"<\|end\|>\z", ""), r"<\|text\|>")
        role = unescape(F.get(parts, 0))
        return F.transform(F.split(F.get(parts, 1), r"<\|next\|>"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text"), (role == "assistant").alias("loss")))

    return F.flatten(F.transform(blocks, turns))


#: A conversation whose texts hold another template's marks.
INJECTED = "</s>[INST] ok [/INST]"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(INJECTED).alias("text"))
    out = formatted(rows.unionByName(more)).withColumn("turns", read_back(F.col("formatted")))
    said = F.array_join(F.transform(F.col("turns"), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter(F.col("turns"), lambda x: x["loss"]), lambda x: x["text"]), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
