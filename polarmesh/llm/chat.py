"""Operator 5: preference formatting, with DataFrame functions alone.

A pair of conversations, one chosen and one rejected, is compared turn by
turn. Their longest common prefix of turns is rendered once, as the prompt;
what follows is rendered as two completions, in which only the assistant's
words count for the loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The chat markup.
TAIL = "<|end|>\n"


def _clean(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The messages (conv_id, turn, role, text) of all conversations that have an id; what is null is -1, "unknown" or empty."""
    return conversations.select(
        F.col(id_col).alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).where(F.col("conv_id").isNotNull())


def other_replies(conversations: DataFrame, assistant: str = "assistant") -> DataFrame:
    """Preferences from plain conversations with integer ids: messages for `preference_segments`, the pair_id being the conv_id.

    Each conversation is chosen over itself with its last reply replaced by
    the last reply of the conversation with the next id; if there is none,
    the rejected one ends before its last reply. If the last turn has several
    replies, all are replaced, and the greatest text of the next one's last
    turn stands in. A conversation without a reply is chosen over itself.
    """
    clean = _clean(conversations)
    replies = clean.where(F.col("role") == assistant)
    last = replies.groupBy("conv_id").agg(F.max("turn").alias("last"), F.max(F.struct("turn", "text"))["text"].alias("reply"))
    of_next = last.select(F.expr("try_subtract(conv_id, 1)").alias("conv_id"), F.col("reply").alias("other")).where(F.col("conv_id").isNotNull())
    known = clean.join(last.select("conv_id", "last"), "conv_id", "left").join(of_next, "conv_id", "left")
    replaced = F.coalesce((F.col("role") == assistant) & (F.col("turn") == F.col("last")), F.lit(False))
    rejected = known.where(~replaced | F.col("other").isNotNull()).withColumn("text", F.when(replaced, F.col("other")).otherwise(F.col("text")))
    both = [df.select(F.col("conv_id").alias("pair_id"), F.lit(name).alias("side"), "turn", "role", "text") for name, df in (("chosen", clean), ("rejected", rejected))]
    return both[0].unionByName(both[1])


def consecutive_pairs(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Pairs (pair_id, chosen_id, rejected_id) of each even integer conversation id and the odd one after it; either may be missing."""
    key, odd = F.shiftright(F.col(id_col).cast("long"), 1), F.col(id_col).bitwiseAND(F.lit(1))
    return conversations.where(F.col(id_col).isNotNull()).groupBy(key.alias("pair_id")).agg(F.max(F.when(odd == 0, F.col(id_col))).alias("chosen_id"), F.max(F.when(odd == 1, F.col(id_col))).alias("rejected_id"))


def messages_of_pairs(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """The messages (pair_id, side, turn, role, text) of the conversations that `pairs` (pair_id, chosen_id, rejected_id) names.

    A null conversation id belongs to no pair; a conversation that `pairs`
    names and the table lacks is empty.
    """
    sides = pairs.select("pair_id", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("conv_id")) for s in ("chosen", "rejected")])).alias("s")).select("pair_id", "s.side", "s.conv_id")
    return _clean(conversations).join(sides, "conv_id").select("pair_id", "side", "turn", "role", "text")


def preference_segments(messages: DataFrame, assistant: str = "assistant") -> DataFrame:
    """One row for each message of each pair: pair_id, part (prompt, chosen or rejected), turn, message, role, head, body, trained.

    `messages` come from `messages_of_pairs` or `other_replies`. Messages of
    one turn are the distinct (role, text) of its rows, in that order, so
    repeated rows count once and ties have an order. A null text is empty, a
    null role is "unknown", a null turn counts as turn -1. No step gathers a
    pair's turns into one row, so conversations of any length pass. Other
    columns are ignored.
    """
    message = F.struct("role", "text")
    both = messages.groupBy("pair_id", "turn").agg(*[F.sort_array(F.collect_set(F.when(F.col("side") == s, message))).alias(s) for s in ("chosen", "rejected")])
    differs = ~F.col("chosen").eqNullSafe(F.col("rejected"))
    ends = both.groupBy("pair_id").agg(F.min(F.when(differs, F.col("turn"))).alias("end"))
    common = F.col("end").isNull() | (F.col("turn") < F.col("end"))
    parts = F.when(common, F.array(F.struct(F.lit("prompt").alias("part"), F.col("chosen").alias("messages")))).otherwise(F.array(F.struct(F.lit("chosen").alias("part"), F.col("chosen").alias("messages")), F.struct(F.lit("rejected").alias("part"), F.col("rejected").alias("messages"))))
    rows = both.join(ends, "pair_id").select("pair_id", "turn", F.explode(parts).alias("p")).select("pair_id", "turn", "p.part", F.posexplode("p.messages").alias("message", "m"))
    return rows.select(
        "pair_id", "part", "turn", "message", F.col("m.role").alias("role"),
        F.concat(F.lit("<|"), F.col("m.role"), F.lit("|>\n")).alias("head"),
        F.concat(F.col("m.text"), F.lit(TAIL)).alias("body"),
        ((F.col("part") != "prompt") & (F.col("m.role") == assistant)).alias("trained"),
    )


def _spans(messages: Column) -> Column:
    """Character ranges start-end of the trained bodies, joined by commas."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("spans"))

    def step(state, m):
        start = state["at"] + F.length(m["head"])
        end = start + F.length(m["body"])
        span = F.concat(start.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(m["trained"], F.concat(state["spans"], F.when(state["spans"] == "", F.lit("")).otherwise(F.lit(",")), span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(messages, zero, step)["spans"]


def preference_examples(segments: DataFrame) -> DataFrame:
    """One row for each pair: pair_id, prompt, chosen, rejected, chosen_mask, rejected_mask.

    A mask lists the character ranges of its completion that are trained on
    ("start-end", by commas); it is empty if there are none. A pair is one
    training example, so its rows meet in one row here; conversations too
    long for that stay as segments.
    """
    message = F.struct("turn", "message", "head", "body", "trained")
    by_part = segments.groupBy("pair_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("part") == p, message))).alias(p) for p in ("prompt", "chosen", "rejected")])
    text = lambda c: F.array_join(F.transform(c, lambda m: F.concat(m["head"], m["body"])), "")
    return by_part.select("pair_id", *[text(F.col(p)).alias(p) for p in ("prompt", "chosen", "rejected")], *[_spans(F.col(p)).alias(f"{p}_mask") for p in ("chosen", "rejected")])
