"""What operators share: cutting lineages, and joins that stay on the executors."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Shuffle files go when the job that made them ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Frames made within leave no shuffle files: for jobs whose results are kept elsewhere. A plan takes the setting of when it was made."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, kept in the folder that spark.checkpoint.dir names; in local mode a temporary one where that is unset. Shuffle files of its job go with that."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="tidemark-"))
    with passing(df.sparkSession):
        return df.select("*").checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join by shuffle, of tables that grow with the input: shuffle files of repetitive rows are small, and the rows made of them would fill the driver if they were broadcast."""
    return df.hint("merge")


#: A round's rows up to this number may be broadcast.
FEW = 50_000


def of_round(df: DataFrame, n: int) -> DataFrame:
    """A round's n rows for a join with a table: few of them go to the table's tasks, many meet it by shuffle."""
    return df.hint("broadcast") if n <= FEW else shuffled(df)
