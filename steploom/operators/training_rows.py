"""Rows for preference training, with the counters of their preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steploom.operators.masks import document_spans, inside, word_spans


def masked_words(text: Column) -> Column:
    """How many words of a text lie in retrieved documents, which no loss is taken of."""
    return F.size(F.filter(inside(word_spans(text), document_spans(text)), lambda x: x))


def step_rows(steps: DataFrame, separator: str = "\n") -> DataFrame:
    """(trajectory_id, step_id, prompt, completion, good, n_words, n_masked) of every labelled step.

    ``steps``: trajectory_id, step_id, question, text, label (1 good, 0 bad, null unlabelled). The
    prompt is the question and the steps before; unlabelled steps stand in prompts and give no row.
    A null text is empty.
    """
    text = F.coalesce("text", F.lit(""))
    told = steps.groupBy("trajectory_id").agg(F.first("question", ignorenulls=True).alias("question"), F.array_sort(F.collect_list(F.struct("step_id", text.alias("text"), "label"))).alias("s"))
    rows = told.select("trajectory_id", "question", "s", F.posexplode("s").alias("i", "x")).where("x.label is not null")
    before = F.transform(F.slice("s", F.lit(1), F.col("i")), lambda x: x["text"])
    made = rows.select("trajectory_id", "x.step_id", F.concat_ws(separator, F.coalesce("question", F.lit("")), before).alias("prompt"), F.col("x.text").alias("completion"), (F.col("x.label") == 1).alias("good"))
    return made.withColumn("n_words", F.size(word_spans(F.col("completion")))).withColumn("n_masked", masked_words(F.col("completion")))


def step_counters(steps: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: steps, kept, skipped, good, bad, words, masked words."""
    total = steps.agg(F.count("*").alias("n_steps"))
    kept = rows.agg(F.count("*").alias("n_kept"), F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("n_words"), F.coalesce(F.sum("n_masked"), F.lit(0)).alias("n_masked"))
    both = total.join(F.broadcast(kept))  # one row each
    return both.select("n_steps", "n_kept", (F.col("n_steps") - F.col("n_kept")).alias("n_skipped"), "n_good", "n_bad", "n_words", "n_masked")


def pair_rows(pairs: DataFrame, texts: DataFrame, prompt: str = "prompt", text: str = "text") -> DataFrame:
    """(question_id, prompt, chosen, rejected, margin) from pairs of attempt ids and ``texts`` (trajectory_id, prompt, text).

    Pairs of which a text is missing or both are equal are left out.
    """
    side = texts.select("trajectory_id", F.col(prompt).alias("p"), F.col(text).alias("t"))
    chosen, rejected = side.toDF("chosen", "prompt", "c"), side.select(F.col("trajectory_id").alias("rejected"), F.col("t").alias("r"))
    rows = pairs.join(chosen, "chosen").join(rejected, "rejected").where("c is not null and r is not null and c <> r")
    return rows.select("question_id", "prompt", F.col("c").alias("chosen"), F.col("r").alias("rejected"), "margin")


def pair_counters(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: pairs, kept, skipped and mean margin of those kept."""
    both = pairs.agg(F.count("*").alias("n_pairs")).join(F.broadcast(rows.agg(F.count("*").alias("n_kept"), F.avg("margin").alias("mean_margin"))))
    return both.select("n_pairs", "n_kept", (F.col("n_pairs") - F.col("n_kept")).alias("n_skipped"), "mean_margin")


def annotations_json(value: Column) -> Column:
    """Annotations (struct, array or map) as JSON; null stays null."""
    return F.to_json(value)


def annotations_of(text: Column, schema: str) -> Column:
    """Annotations read from JSON; null for text that isn't JSON of this schema."""
    return F.from_json(text, schema)
