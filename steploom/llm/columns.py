"""Column expressions the training-data queries share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def carried_question(trajectory_id: Column) -> Column:
    """The part before the last ``_sample_``, or the whole id when it has none."""
    return F.regexp_replace(trajectory_id, r"(?s)^(.*)_sample_.*$", "$1")


def question_of(question_id: Column, trajectory_id: Column) -> Column:
    """The question id, or the carried one where it is null."""
    return F.coalesce(question_id, carried_question(trajectory_id))
