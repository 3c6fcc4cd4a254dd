"""How rows are dealt to tasks that sort them."""

from __future__ import annotations

from pyspark.sql import DataFrame

SHARE = 4


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows, those of one key in one task, over four times the usual number of tasks.

    Rows of numbers take ten times as much memory in a sort as in a shuffle file, by which adaptive execution would join them into
    few tasks; a number that is given is kept.
    """
    return rows.repartition(SHARE * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
