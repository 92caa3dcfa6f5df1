"""Instruction pairs from message trees and conversations."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strataloom.functions.hashing import pair_key
from strataloom.functions.text import squeeze
from strataloom.operators.filters import first_of_equal


def pair_messages(messages: DataFrame, max_chars: int = 2000, lang: str = "en", order: str = "ord", max_pairs: int | None = None) -> DataFrame:
    """instruction, input, output, ord of replies whose prompt came before them.

    messages: message_id, parent_id, role (prompter | assistant), lang, text, and an order. Of prompts with one id the last
    before the reply counts; of replies to equal prompts the first.
    """
    rows = messages.where(F.col("lang") == lang).withColumn("text", squeeze(F.col("text")))
    rows = rows.where((F.col("text") != "") & (F.length("text") <= max_chars))
    prompts = rows.where((F.col("role") == "prompter") & F.col("message_id").isNotNull() & (F.col("message_id") != "")).select(F.col("message_id").alias("parent_id"), F.col("text").alias("instruction"), F.col(order).alias("__asked"))
    # a prompt holds from its own place to that of the next one with its id
    until = F.lead("__asked").over(Window.partitionBy("parent_id").orderBy("__asked"))
    prompts = prompts.withColumn("__until", until).alias("p")
    replies = rows.where(F.col("role") == "assistant").select("parent_id", F.col("text").alias("output"), F.col(order).alias("ord")).alias("r")
    on = (F.col("p.parent_id") == F.col("r.parent_id")) & (F.col("p.__asked") < F.col("r.ord")) & (F.col("p.__until").isNull() | (F.col("p.__until") > F.col("r.ord")))
    pairs = replies.join(prompts, on).select("p.instruction", F.lit("").alias("input"), "r.output", "r.ord")
    pairs = first_of_equal(pairs, F.md5("instruction"), "ord")
    return pairs if max_pairs is None else pairs.orderBy("ord").limit(max_pairs)


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as messages: the parent of a turn is the turn before it."""
    name = lambda turn: F.concat_ws("-", "conv_id", turn)
    role = F.when(F.col("role") == "user", "prompter").otherwise(F.col("role"))
    return conversations.select(name(F.col("turn")).alias("message_id"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent_id"), role.alias("role"), F.lit("en").alias("lang"), "text", (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("ord"))


def instruction_records(rows: DataFrame, order: str = "ord", max_output: int = 2000, max_pairs: int | None = None) -> DataFrame:
    """instruction, input, output of records (instruction, context, response); the output's length is limited."""
    made = rows.select(squeeze(F.col("instruction")).alias("instruction"), squeeze(F.col("context")).alias("input"), squeeze(F.col("response")).alias("output"), F.col(order).alias("ord"))
    made = made.where((F.col("instruction") != "") & (F.col("output") != "") & (F.length("output") <= max_output))
    return made if max_pairs is None else made.orderBy("ord").limit(max_pairs)


def dedup_pairs(pairs: DataFrame, order: str = "ord") -> DataFrame:
    """The first of pairs with equal instruction and output."""
    return first_of_equal(pairs, pair_key(F.col("instruction"), F.col("output")), order)


def prompt_text(instruction: Column, context: Column) -> Column:
    return F.concat(F.lit("Instruction: "), instruction, F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("\nInput: "), context)).otherwise(""))


@F.pandas_udf(StringType())
def canonical_json(instruction: pd.Series, context: pd.Series, output: pd.Series) -> pd.Series:
    """The pair as JSON with sorted keys and escaped characters, by which it is split."""
    return pd.Series([json.dumps({"instruction": a, "input": b, "output": c}, sort_keys=True) for a, b, c in zip(instruction, context, output)])


def pair_source(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of a JSON-lines file; blank lines are no pairs."""
    rows = spark.read.schema("instruction string, input string, output string").json(path)
    return rows.where("instruction IS NOT NULL OR output IS NOT NULL")
