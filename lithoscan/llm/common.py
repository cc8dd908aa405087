"""Helpers shared by the training-data operators: worker paths and small column
expressions.

Every operator starts by projecting the columns it needs under its own names,
so columns of the input with clashing names neither reach nor break it.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialize, scratch_path, shared_dir

# The white space class [\x20\x09-\x0D] and the ASCII capitals.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Stands for a null identifier inside an operator: it sorts below all others.
NULL_ID = -(2**63)

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_or_lowest(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID).cast("long"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def null_id(name: str) -> Column:
    """Turn the stand-in of a null identifier back into null."""
    return F.when(F.col(name) != F.lit(NULL_ID).cast("long"), F.col(name))


__all__ = [
    "ASCII_SPACE", "LOWER", "NULL_ID", "UPPER", "ascii_lower", "discard", "id_or_lowest", "materialize", "null_id", "prepare",
    "scratch_path", "shared_dir", "text_or_empty",
]
