"""Message intents and conversation context."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.functions.arrays import let
from gridlens.functions.columns import quoted
from gridlens.operators.ranking import bucketed_row_number

# Intents in the order they are tried; a rule holds when every
# group has one of its keywords in the lower-cased message.
INTENT_RULES = (
    ("greeting", (("hello", "hi", "hey", "greetings"),)),
    ("machine_learning", (("machine learning", " ml "),)),
    ("deep_learning", (("deep learning", "neural network", "cnn"),)),
    ("xgboost", (("xgboost", "gradient boosting"),)),
    ("lightgbm", (("lightgbm",),)),
    ("overfitting", (("overfitting", "underfitting"),)),
    ("python", (("python",),)),
    ("nlp", (("nlp", "natural language", "text"),)),
    ("preprocessing", (("data",), ("clean", "preprocess"))),
    ("random_forest", (("random forest", "rf "),)),
    ("classification", (("classification",),)),
    ("regression", (("regression",),)),
    ("api_key", (("api", "key", "openai", "gpt"),)),
    ("help", (("help", "what can you do"),)),
)

# The shorter list of the plain responder.
SHORT_INTENT_RULES = (
    ("greeting", (("hello", "hi", "hey"),)),
    ("machine_learning", (("machine learning", " ml "),)),
    ("deep_learning", (("deep learning", "neural"),)),
    ("xgboost", (("xgboost", "gradient boosting"),)),
    ("overfitting", (("overfitting",),)),
    ("python", (("python",),)),
    ("nlp", (("nlp", "natural language"),)),
)
DEFAULT_INTENT = "default"
CONTEXT_PAIRS = 4
TURNS_PER_BUCKET = 100_000


def intent(message: Column, rules: Sequence = INTENT_RULES, match: str = "substring") -> Column:
    """(intent, rule) of a message; the first rule that holds wins.

    ``match="substring"`` finds keywords inside other words ("hi" in
    "machine"), ``match="word"`` only whole words.
    """
    if match not in ("substring", "word"):
        raise ValueError("match is substring or word")

    def any_of(text: Column, keywords: Sequence[str]) -> Column:
        if match == "word":
            words = "|".join(re.escape(k.strip()) for k in keywords)
            return text.rlike(f"(?<![a-z0-9])({words})(?![a-z0-9])")
        return reduce(lambda a, b: a | b, [F.contains(text, F.lit(k)) for k in keywords])

    def choose(text: Column) -> Column:
        found = None
        for number, (name, groups) in enumerate(rules, start=1):
            holds = reduce(lambda a, b: a & b, [any_of(text, g) for g in groups])
            outcome = F.struct(F.lit(name).alias("intent"), F.lit(number).alias("rule"))
            found = F.when(holds, outcome) if found is None else found.when(holds, outcome)
        return found.otherwise(
            F.struct(F.lit(DEFAULT_INTENT).alias("intent"), F.lit(len(rules) + 1).alias("rule"))
        )

    return let(F.lower(message), choose) if match == "word" else choose(F.lower(message))


def message_intents(
    df: DataFrame, text: str, rules: Sequence = INTENT_RULES, match: str = "substring"
) -> DataFrame:
    """Append intent and rule number."""
    return df.withColumn("_i", intent(quoted(text), rules, match)).select(
        *[quoted(c) for c in df.columns], F.col("_i.intent").alias("intent"),
        F.col("_i.rule").alias("rule"),
    )


def intent_counts(df: DataFrame, text: str, rules: Sequence = INTENT_RULES,
                  match: str = "substring") -> DataFrame:
    """(intent, rule, messages), rules in order."""
    return (
        message_intents(df, text, rules, match)
        .groupBy("intent", "rule")
        .agg(F.count("*").alias("messages"))
        .orderBy("rule")
    )


def chat_context(
    df: DataFrame, conversation: str, turn: str, role: str, text: str, pairs: int = CONTEXT_PAIRS,
    hint: str | None = None, block: int = 4096,
) -> DataFrame:
    """(conversation, turn, prompt, context) for every user message.

    ``context`` holds the messages of the last ``pairs`` exchanges as
    structs (role, content); ``prompt`` is the hint, a blank line and the
    message.

    A conversation is cut into blocks of messages and each block also gets
    the last messages of the block before, so one endless conversation is
    worked on by many tasks.
    """
    reach = 2 * pairs
    if block <= reach:
        raise ValueError("block must be longer than the context")
    said = df.where(quoted(role).isin("user", "assistant")).select(
        quoted(conversation).alias("conversation"), quoted(turn).alias("turn"),
        quoted(role).alias("role"), quoted(text).alias("content"),
    )
    placed = bucketed_row_number(
        said, ["conversation"], F.floor(F.col("turn") / TURNS_PER_BUCKET), [F.col("turn"), F.col("role"), F.col("content")], "_pos"
    )
    place = F.col("_pos") - 1
    home = F.floor(place / block)
    copies = F.when(place % block >= block - reach, F.array(home, home + 1)).otherwise(F.array(home))
    blocks = placed.withColumn("_home", home).withColumn("_block", F.explode(copies))
    before = Window.partitionBy("conversation", "_block").orderBy("_pos").rowsBetween(-reach, -1)
    prompt = F.concat(F.lit(f"{hint}\n\n"), F.col("content")) if hint else F.col("content")
    return (
        blocks.withColumn("context", F.collect_list(F.struct("role", "content")).over(before))
        .where((F.col("_block") == F.col("_home")) & (F.col("role") == "user"))
        .select(F.col("conversation").alias(conversation), F.col("turn").alias(turn),
                prompt.alias("prompt"), "context")
    )
