"""What the operators of this subpackage share: tables, the shared folder, small text helpers.

Every operator selects the columns it needs by name, so extra columns of any
name are ignored unless an operator says that it passes rows through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.scratch import Scratch, release, shared_folder

__all__ = ["Scratch", "release", "shared_folder", "sized_broadcast", "table", "whole", "word_array"]

#: The largest table, in rows of a few numbers, that is broadcast; beyond it a shuffled join is used.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are few enough, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def whole(text: Column) -> Column:
    """A text with null as empty."""
    return F.coalesce(text, F.lit(""))


#: Fixed: characters that separate words for sizes and quality rules.
SPACE = r"[\x20\x09-\x0D]"


def word_array(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text, null as empty."""
    return F.array_remove(F.split(whole(text), SPACE + "+", -1), "")
