"""The best rows of each group, in bounded memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The k best rows of each group, with their rank from 1.

    Spark keeps k rows of a group in each task before the shuffle and k after it (WindowGroupLimit), so a group of any size sends k rows a task,
    and no group is gathered. `order` should tell all rows apart; of rows that it doesn't, any may be kept.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
