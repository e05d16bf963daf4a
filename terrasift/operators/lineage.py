"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from terrasift.session import shared_root


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a table in the shared folder that ``spark.checkpoint.dir`` names.

    A lost executor costs no more than reading it again, and what is derived from it sees the same rows each time.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
