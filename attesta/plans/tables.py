"""Input tables, and small relations shared by a query and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.scratch import stage

__all__ = ["read", "spread", "sql_literal", "stage", "values"]


#: Bytes of a table, as it is stored, that one task may well do alone, and that may be moved to give every core a part.
LITTLE, SMALL = 1 << 20, 1 << 30


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"))


def spread(table: DataFrame) -> DataFrame:
    """A small table over all cores, where its scan has fewer parts than there are cores (one row group is one task). Any other as it is scanned."""
    planned, cores = table._jdf.queryExecution(), table.sparkSession.sparkContext.defaultParallelism
    size = int(str(planned.optimizedPlan().stats().sizeInBytes()))
    return table.repartition(cores) if LITTLE < size < SMALL and planned.toRdd().getNumPartitions() < cores else table


def sql_literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, list | tuple):
        return "[" + ", ".join(map(sql_literal, x)) + "]"
    if isinstance(x, int | float):
        return repr(x)
    return "'" + str(x).replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """A VALUES relation in SQL."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(sql_literal, r)) + ")" for r in rows) + f") AS t({names})"
