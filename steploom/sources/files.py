"""Readers and writers of JSON and Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steploom.functions.text import truncate_marked
from steploom.plans.storage import store
from steploom.sources import schemas


def read_json_rows(spark: SparkSession, path: str | list[str], schema: str, layout: str = "jsonl", limit: int | None = None, tolerant: bool = False) -> DataFrame:
    """Rows of JSON lines, or of JSON arrays (``layout`` json). Tolerant reading drops broken lines."""
    if layout not in ("jsonl", "json"):
        raise ValueError(f"unknown layout {layout}")
    rows = spark.read.schema(schema).json(path, multiLine=layout == "json", mode="DROPMALFORMED" if tolerant else "FAILFAST")
    return rows if limit is None else rows.limit(limit)


def read_trajectories(spark: SparkSession, path: str | list[str], layout: str = "jsonl", limit: int | None = None) -> DataFrame:
    """Trajectory files with the file each row came from; rows without an id or question are an error."""
    rows = read_json_rows(spark, path, schemas.TRAJECTORY, layout, limit).withColumn("source", F.input_file_name())
    return schemas.required(schemas.normalised_trajectories(rows), "trajectory_id", "question")


def read_questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Questions from JSON lines, a JSON array, an object with ``data``, or a single object."""
    if path.endswith(".jsonl"):
        return schemas.normalised_questions(read_json_rows(spark, path, schemas.QUESTION, limit=limit))
    fields = ("id", "_id", "question", "answer", "gold_answer")
    own = ", ".join(f"{f} string" for f in fields)
    item = ", ".join(f"{f}: string" for f in fields)
    # a JSON array gives a row an element as it is parsed; an object with data is unfolded
    rows = spark.read.schema(f"{own}, data array<struct<{item}>>").json(path, multiLine=True)
    rows = rows.select(F.explode(F.coalesce("data", F.array(F.struct(*fields)))).alias("r")).select("r.*")
    return schemas.normalised_questions(rows if limit is None else rows.limit(limit))


def read_corpus(spark: SparkSession, path: str | list[str], limit_chars: int = 1200) -> DataFrame:
    """(doc_id, title, text) of corpus files in any of their layouts; long texts are cut with a mark.

    Documents without an id are named by their place in the files, counted from 0 without gaps.
    """
    rows = read_json_rows(spark, path, schemas.CORPUS, tolerant=True)
    if rows.where("id is null and _id is null").isEmpty():
        numbered = rows.withColumn("n", F.lit(None).cast("long"))
    else:
        numbered = with_ordinal(rows.withColumn("__file", F.input_file_name()).withColumn("__line", F.monotonically_increasing_id()), "__file", "__line").withColumnRenamed("ord", "n")
    title = F.coalesce("title", "wikipedia_title", F.substring_index("contents", "\n", 1), F.lit(""))
    body = F.coalesce("text", F.regexp_replace("contents", r"(?s)^[^\n]*\n?", ""), F.lit(""))
    return numbered.select(F.coalesce("id", "_id", F.concat(F.lit("doc_"), F.col("n").cast("string"))).alias("doc_id"), title.alias("title"), truncate_marked(body, limit_chars).alias("text"))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Tree nodes; missing counters are 0."""
    return read_json_rows(spark, path, schemas.NODE).fillna({"visit_count": 0, "total_value": 0.0})


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return read_json_rows(spark, path, schemas.PAIR)


def read_experiment(spark: SparkSession, path: str) -> DataFrame:
    """One row a usable checkpoint, its evaluation results as a map."""
    rows = read_json_rows(spark, path, schemas.EXPERIMENT, "json")
    flat = rows.select(F.col("name").alias("experiment"), F.posexplode("checkpoints").alias("place", "c")).select("experiment", "place", "c.*")
    return flat.where(F.col("status").isin("completed", "evaluated"))


def processed_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids that an earlier run has written; broken lines are passed over."""
    rows = read_json_rows(spark, path, "trajectory_id string, question_id string", tolerant=True)
    return rows.select(F.coalesce("trajectory_id", "question_id").alias("trajectory_id")).where("trajectory_id is not null").distinct()


def write_rows(df: DataFrame, path: str, layout: str = "parquet", mode: str = "errorifexists") -> None:
    """Parquet, or JSON lines without null fields."""
    if layout == "parquet":
        df.write.mode(mode).parquet(path)
    elif layout == "jsonl":
        df.write.mode(mode).option("ignoreNullFields", "true").json(path)
    else:
        raise ValueError(f"unknown layout {layout}")


def write_labeled(df: DataFrame, path: str, layout: str = "jsonl", include_filtered: bool = False) -> None:
    """Labelled trajectories, filtered ones only when asked for."""
    write_rows(df if include_filtered else df.where("not is_filtered"), path, layout)


def with_ordinal(df: DataFrame, *order: str) -> DataFrame:
    """A dense arrival ordinal by a total order, from range-partitioned counts instead of one sorted task."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    # stored, as range borders come from samples and could differ if this were worked out twice
    ranged = store(ranged.withColumn("__i", F.monotonically_increasing_id() % F.lit(1 << 33)), "ordinal")
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__c"))  # a row a partition
    before = counts.withColumn("__before", F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).drop("__c")
    return ranged.join(F.broadcast(before), "__p").withColumn("ord", F.col("__before") + F.col("__i")).drop("__p", "__i", "__before")


def corpus_from_contexts(questions: DataFrame) -> DataFrame:
    """(doc_id, title, text) from questions' contexts: array<struct<title, sentences>>; repeats dropped.

    Two passages are the same when their title and first 100 characters are; the first question's stays.
    """
    rows = questions.select("question_id", F.posexplode("context").alias("pos", "c")).select("question_id", "pos", F.col("c.title").alias("title"), F.array_join("c.sentences", " ").alias("text"))
    key = F.concat("title", F.lit("::"), F.substring("text", 1, 100))
    first = rows.groupBy(key.alias("k")).agg(F.min(F.struct("question_id", "pos", "title", "text")).alias("f"))
    flat = first.select("f.*")
    return with_ordinal(flat, "question_id", "pos").select(F.concat(F.lit("doc_"), F.col("ord").cast("string")).alias("doc_id"), "title", "text")


def write_checkpoint(nodes: DataFrame, path: str, rollout: int) -> None:
    """Tree nodes with a meta row; the meta file comes last, so a checkpoint with it is whole."""
    nodes.write.mode("overwrite").parquet(f"{path}/rollout={rollout}/nodes")
    spark = nodes.sparkSession
    n = spark.read.parquet(f"{path}/rollout={rollout}/nodes").count()
    spark.createDataFrame([(rollout, n)], "completed_rollout int, num_nodes long").write.mode("overwrite").json(f"{path}/meta/rollout={rollout}")


def read_checkpoint(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """(completed rollout, nodes) of the latest whole checkpoint."""
    meta = spark.read.schema("completed_rollout int, num_nodes long").json(f"{path}/meta/*")
    last = meta.agg(F.max("completed_rollout")).first()[0]
    return last, spark.read.parquet(f"{path}/rollout={last}/nodes")


def write_judged(df: DataFrame, path: str, documents: str = "documents", limit: int = 2000) -> None:
    """Judged steps as JSON lines, their documents cut; null fields are left out."""
    write_rows(df.withColumn(documents, F.substring(documents, 1, limit)), path, "jsonl")


def write_scores(df: DataFrame, path: str, scores: str = "critic_step_scores") -> None:
    """Per-trajectory scores with their minimum."""
    write_rows(df.withColumn("critic_min", F.array_min(scores)), path, "jsonl")


def write_training_samples(labeled: DataFrame, path: str, layout: str = "jsonl") -> None:
    """A row a labelled step with the steps before it, of trajectories that weren't filtered.

    ``labeled``: trajectory_id, question, steps (array of struct with step_id), labels (array), is_filtered.
    """
    kept = labeled.where("not is_filtered").select("trajectory_id", "question", "steps", F.posexplode("labels").alias("i", "label"))
    rows = kept.where("label is not null").select("trajectory_id", F.col("i").alias("step_id"), "question", F.slice("steps", F.lit(1), F.col("i")).alias("prefix"), F.get("steps", F.col("i")).alias("step"), "label")
    write_rows(rows, path, layout)


def distinct_questions(trajectories: DataFrame, order: str = "trajectory_id") -> DataFrame:
    """(question_id, question, gold_answer) of each question's first trajectory by ``order``."""
    from steploom.functions.text import question_id_of

    rows = trajectories.select(question_id_of(F.col("trajectory_id")).alias("question_id"), F.col(order).alias("__order"), "question", "gold_answer")
    return rows.groupBy("question_id").agg(F.min_by(F.struct("question", "gold_answer"), "__order").alias("f")).select("question_id", "f.question", "f.gold_answer")


def write_trees(nodes: DataFrame, path: str) -> None:
    """Search trees as a node table, by question."""
    nodes.repartition("question_id").sortWithinPartitions("question_id", "id").write.parquet(path)


def read_trees(spark: SparkSession, path: str, max_children: int, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, trees) that :func:`write_trees` wrote.

    Missing counters of nodes are 0. ``trees`` has a row a question: root, next_id, n_nodes and
    n_expandable, the nodes that can still get a child.
    """
    nodes = spark.read.parquet(path)
    for name, kind in (("visit_count", "long"), ("total_value", "double"), ("is_terminal", "boolean")):
        zero = F.lit(False if kind == "boolean" else 0).cast(kind)
        nodes = nodes.withColumn(name, F.coalesce(F.col(name).cast(kind), zero) if name in nodes.columns else zero)
    kids = nodes.where("parent_id is not null").groupBy("question_id", F.col("parent_id").alias("id")).agg(F.count("*").alias("n_children"))
    open_ = ~F.col("is_terminal") & (F.coalesce("n_children", F.lit(0)) < max_children) & (F.col("depth") < max_depth)
    trees = nodes.join(kids, ["question_id", "id"], "left").groupBy("question_id").agg(
        F.min(F.when(F.col("parent_id").isNull(), F.col("id"))).alias("root"), (F.max("id") + 1).alias("next_id"), F.count("*").alias("n_nodes"), F.count_if(open_).alias("n_expandable")
    )
    return nodes, trees


def write_vectors(vectors: DataFrame, path: str, key: str, vector: str) -> None:
    """A table of vectors by key; vectors of different widths are an error."""
    width = vectors.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if width[0] != width[1]:
        raise ValueError(f"vectors of {width[0]} and of {width[1]} numbers")
    vectors.select(key, vector).write.parquet(path)


def read_vectors(spark: SparkSession, path: str, n: int | None = None, key: str = "vec_id") -> DataFrame:
    """Stored vectors, those of the first ``n`` keys; too few of them is an error."""
    from steploom.operators.retrieval import truncated_to_corpus

    vectors = spark.read.parquet(path)
    return vectors if n is None else truncated_to_corpus(vectors.withColumnRenamed(key, "vec_id"), n).withColumnRenamed("vec_id", key)


def steps_to_judge(trajectories: DataFrame) -> DataFrame:
    """(trajectory_id, question, gold_answer, step_id, step_type, text, previous) of every step of read trajectories.

    Texts are rebuilt from the steps' fields as tags. Step ids count from 0, those of files that count from 1 are
    shifted, and an ``answer`` step is called ``finish``.
    """
    from steploom.functions.formatting import step_text

    text = F.transform("steps", lambda s: step_text(s["think"], s["search"], s["answer"], s["documents"]))
    low = F.array_min(F.transform("steps", lambda s: s["step_id"]))
    rows = trajectories.withColumn("__texts", text).withColumn("__low", F.when(low >= 1, 1).otherwise(0))
    rows = rows.select("trajectory_id", "question", "gold_answer", "__texts", "__low", F.posexplode("steps").alias("i", "s"))
    kind = F.when(F.col("s.step_type") == "answer", "finish").otherwise(F.col("s.step_type"))
    return rows.select("trajectory_id", "question", "gold_answer", (F.coalesce("s.step_id", F.col("i") + F.col("__low")) - F.col("__low")).alias("step_id"), kind.alias("step_type"), F.get("__texts", F.col("i")).alias("text"), F.slice("__texts", F.lit(1), F.col("i")).alias("previous"))
