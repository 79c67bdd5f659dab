"""Tables that a join may broadcast, after a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, computed and broadcast by its joins if it has at most ``most`` rows; else as it is, and Spark joins by shuffle.

    At most ``most`` + 1 rows reach the driver. For tables of a few plain columns.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
