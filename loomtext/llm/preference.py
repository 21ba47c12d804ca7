"""Preference formatting: the common prompt of a chosen and a rejected conversation, and their masked completions.

The longest common prefix of turns (equal role and text) is rendered once as prompt. What follows in each conversation
is rendered as its completion, and spans of characters in the completion say which parts count for the loss: the text
and closing mark of the assistant's turns. Everything is made of DataFrame functions, row by row after one grouping of
the turns into conversations.

A conversation is one training record and so one row; the turns of one conversation meet in one place by nature, those
of different conversations never do, however often a first turn or a whole conversation recurs.

Edge cases: null role or text counts as empty; turns are ordered by turn, role and text, turns without a number first;
equal conversations have a prompt of all turns and two empty completions; no common turn: an empty prompt; a pair of
which one side is missing is not emitted; turns without a conversation's id are left out; repeated turns are turns like
others; columns to keep that are named like a result are replaced by it; an empty table gives no pairs. A very long
conversation is one row and must fit its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the template (fixed values of the published ChatML format).
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key, turns`` with turns as array<struct<turn, role, text>> in order."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return turns.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias(key)).agg(F.array_sort(F.collect_list(one)).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))), "")


def loss_spans(turns: Column, role: str = "assistant") -> Column:
    """array<struct<start, end>>: characters of the rendered turns that count, end exclusive."""
    empty = F.array().cast("array<struct<start:long,end:long>>")

    def step(s: Column, t: Column) -> Column:
        body = s["at"] + len(OPEN) + F.length(t["role"]) + 1
        end = body + F.length(t["text"]) + len(CLOSE)
        mine = F.array(F.struct(body.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == role, F.concat(s["spans"], mine)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")), step)["spans"]


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", keep: tuple[str, ...] = ()) -> DataFrame:
    """From two arrays of turns to ``prompt_turns, prompt, chosen, chosen_spans, rejected, rejected_spans``."""
    results = ("prompt_turns", "prompt", "chosen", "chosen_spans", "rejected", "rejected_spans")
    own = [k for k in keep if k not in results]
    kept = [F.col(k).alias(f"k{i}") for i, k in enumerate(own)]
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    rest = lambda c: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    cut = pairs.select(*kept, F.col(chosen).alias("a"), F.col(rejected).alias("b")).where(a.isNotNull() & b.isNotNull()).withColumn("n", common_turns(a, b))
    back = [F.col(f"k{i}").alias(k) for i, k in enumerate(own)]
    cut = cut.select(*[f"k{i}" for i in range(len(own))], "n", F.slice(a, 1, n).alias("p"), rest(a).alias("a"), rest(b).alias("b"))
    out = [render(F.col("p")).alias("prompt")]
    for c, name in (("a", "chosen"), ("b", "rejected")):
        out += [render(F.col(c)).alias(name), loss_spans(F.col(c)).alias(f"{name}_spans")]
    return cut.select(*back, n.alias("prompt_turns"), *out)


def counterfactual_pairs(convs: DataFrame, key: str = "conv_id") -> DataFrame:
    """Pairs from single conversations: each against itself with its last turn replaced by that of its neighbour.

    Neighbours are the two ids that differ in the lowest bit; a conversation without a neighbour just loses its last turn.
    """
    side = F.struct(F.col(key).alias("id"), F.col("turns"))
    both = convs.groupBy(F.shiftright(key, 1).alias("__pair")).agg(F.array_sort(F.collect_list(side)).alias("__c"))
    two = F.transform("__c", lambda c, i: F.struct(c.alias("a"), F.get("__c", 1 - i).alias("b")))
    both = both.select(F.explode(two).alias("p"))
    own, other = F.col("p.a.turns"), F.col("p.b.turns")
    last = F.when(other.isNotNull(), F.slice(other, -1, 1)).otherwise(F.slice(own, 1, 0))
    made = F.concat(F.slice(own, 1, F.size(own) - 1), last)
    return both.select(F.col("p.a.id").alias(key), own.alias("chosen"), made.alias("rejected"))
