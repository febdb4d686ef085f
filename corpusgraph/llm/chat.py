"""Preference formatting of chat pairs with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.staging import bound

#: How a turn is rendered, and how the place of a completion opens.
TURN = "<|{role}|>\n{text}<|end|>\n"


def _rendered(turns: str) -> str:
    return f"aggregate({turns}, '', (s, t) -> concat(s, '<|', t.role, '|>\\n', t.text, '<|end|>\\n'))"


def _masks(turns: str, before: str) -> str:
    """Spans of code points of the completion's assistant texts, the closing mark included, in prompt and completion together."""
    return (
        f"aggregate({turns}, struct({before} as at, cast(array() as array<struct<start:int,end:int>>) as out),"
        " (a, t) -> struct(a.at + length(t.role) + length(t.text) + 13 as at,"
        " if(t.role = 'assistant', array_append(a.out, struct(a.at + length(t.role) + 5 as start, a.at + length(t.role) + length(t.text) + 12 as end)), a.out) as out), a -> a.out)"
    )


def _turns(side: DataFrame, name: str) -> DataFrame:
    """(pair_id, name): a conversation's turns in order. A conversation is one row by its nature; its rendering is as long."""
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return side.groupBy("pair_id").agg(F.array_sort(F.collect_list(turn)).alias(name))


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """chosen and rejected (pair_id, turn, role, text) -> one row a pair that has both.

    The prompt is the longest common prefix of turns (same role and text), rendered once. Each completion renders what
    follows; its mask lists the spans in prompt + completion that train: the assistants' texts with their closing marks.
    n_common is the number of common turns. Turns are ordered by turn, then role and text, null turns first; null roles
    and texts are empty. If one side is a prefix of the other its completion is empty; two equal sides have identical
    true. Pairs that lack a side, and null pair_ids, give no row.
    """
    both = _turns(chosen, "c").join(_turns(rejected, "r"), "pair_id")
    differ = "filter(zip_with(c, r, (x, y) -> not (x.role <=> y.role and x.text <=> y.text)), d -> d)"
    common = F.expr(f"if(size({differ}) = 0, least(size(c), size(r)), cast(array_position(zip_with(c, r, (x, y) -> not (x.role <=> y.role and x.text <=> y.text)), true) as int) - 1)")
    both = bound(both, n_common=common)
    both = bound(both, prompt=F.expr(_rendered("slice(c, 1, n_common)")), cx=F.expr("slice(c, n_common + 1, greatest(size(c) - n_common, 0))"), rx=F.expr("slice(r, n_common + 1, greatest(size(r) - n_common, 0))"))
    return both.select(
        "pair_id",
        F.col("n_common").cast("long").alias("n_common"),
        "prompt",
        F.expr(_rendered("cx")).alias("chosen"),
        F.expr(_rendered("rx")).alias("rejected"),
        F.expr(_masks("cx", "length(prompt)")).alias("chosen_mask"),
        F.expr(_masks("rx", "length(prompt)")).alias("rejected_mask"),
        F.expr("size(cx) = 0 and size(rx) = 0").alias("identical"),
    )


def neighbours(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations 2p and 2p + 1 as the chosen and the rejected side of pair p: the table names no preferences."""
    rows = conversations.select(F.floor(F.col("conv_id") / 2).alias("pair_id"), (F.col("conv_id") % 2).alias("side"), "turn", "role", "text")
    return rows.where("side = 0"), rows.where("side = 1")
