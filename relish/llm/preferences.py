"""Preference formatting: one prompt for the turns both sides share, and a masked completion for each side.

Built-in functions only.  The messages of one turn number form a slot; a slot counts as shared if both sides hold the
same messages there.  The prompt is all slots before the first that differs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: turn numbers a row of the result covers, so that no conversation has to fit into one task
SLOTS_PER_PART = 64


def _render(messages: Column) -> Column:
    """Messages as one string."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["text"], F.lit("\n"))), "")


def _trained(messages: Column, trained_role: str) -> Column:
    """Start and end (characters from 0, end open) of the trained messages in the rendered string."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<from:bigint,to:bigint>>").alias("spans"))

    def step(state: Column, m: Column) -> Column:
        begin = state["at"] + F.length(m["role"]) + F.lit(5)
        end = (begin + F.length(m["text"]) + F.lit(1)).cast("long")
        span = F.array(F.struct(begin.cast("long").alias("from"), end.alias("to")))
        return F.struct(end.alias("at"), F.when(m["role"] == trained_role, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(messages, start, step, lambda state: state["spans"])


def _side(turns: DataFrame, side: str, pair: str) -> DataFrame:
    return turns.select(F.coalesce(F.concat(F.lit("="), F.col(pair).cast("string")), F.lit("")).alias("pref_key"),
                        F.col(pair).alias("pref_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("slot"),
                        F.lit(side).alias("side"), F.struct(F.coalesce("role", F.lit("")).alias("role"),
                                                            F.coalesce("text", F.lit("")).alias("text")).alias("message"))


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", trained_role: str = "assistant") -> DataFrame:
    """Rows ``pair, part, prompt_turns, prompt, chosen, chosen_trained, rejected, rejected_trained``.

    Both inputs have ``pair``, ``turn``, ``role`` and ``text``; other columns are ignored.  ``part`` numbers stretches of
    64 turn numbers, and the strings of a pair's parts joined in order are its whole prompt and completions; a pair of up
    to 64 turns has one row.  ``*_trained`` are the spans of that string a loss is taken on: contents of ``trained_role``
    after the prompt.  ``prompt_turns`` counts the part's shared turn numbers.

    Same sides: the prompt holds everything, completions are empty.  A side without rows is empty.  NULL pairs are one
    pair, a NULL turn comes before all others, NULL role or text is an empty string.  Identical rows of one side count
    once; different messages with one turn number stand in order of role and text.
    """
    both = _side(chosen, "c", pair).unionByName(_side(rejected, "r", pair))
    sides = [F.array_sort(F.collect_set(F.when(F.col("side") == s, F.col("message")))).alias(s) for s in "cr"]
    slots = both.groupBy("pref_key", "slot").agg(F.min("pref_id").alias("pref_id"), *sides)
    first = (slots.groupBy("pref_key")
             .agg(F.min(F.when(F.col("c") != F.col("r"), F.col("slot"))).alias("cut")).withColumnRenamed("pref_key", "cut_key"))
    cut = slots.join(first, F.col("pref_key") == F.col("cut_key")).withColumn("shared", F.col("cut").isNull() | (F.col("slot") < F.col("cut")))
    held = cut.withColumn("c", F.struct("slot", "shared", F.col("c").alias("m"))).withColumn("r", F.struct("slot", "shared", F.col("r").alias("m")))
    parts = (held.groupBy("pref_key", F.floor(F.col("slot") / SLOTS_PER_PART).cast("long").alias("part"))
             .agg(F.min("pref_id").alias(pair), F.count(F.when(F.col("shared"), 1)).alias("prompt_turns"),
                  F.array_sort(F.collect_list("c")).alias("c"), F.array_sort(F.collect_list("r")).alias("r")))

    def messages(side: str, shared: bool) -> Column:
        return F.flatten(F.transform(F.filter(F.col(side), lambda x: x["shared"] == F.lit(shared)), lambda x: x["m"]))

    named = parts.select(pair, "part", "prompt_turns", messages("c", True).alias("p"), messages("c", False).alias("c"), messages("r", False).alias("r"))
    return named.select(pair, "part", "prompt_turns", _render(F.col("p")).alias("prompt"),
                        _render(F.col("c")).alias("chosen"), _trained(F.col("c"), trained_role).alias("chosen_trained"),
                        _render(F.col("r")).alias("rejected"), _trained(F.col("r"), trained_role).alias("rejected_trained"))
