"""Cuts of lineage that survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local master (tests) gets one of its
    own; on a cluster that would be a folder which no other machine sees, so it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Writes df through the checkpoint folder, so a lost executor costs no recomputation of what came before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """df with c as the column name, made once a row: a filter on a plain column is moved below it, and there every mention of the
    column runs its expression again."""
    return df.select(*[x for x in df.columns if x != name], F.explode(F.array(c)).alias(name))
