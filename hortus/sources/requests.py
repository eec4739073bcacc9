"""Request batches on Parquet, read with the job's explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hortus.sources.schemas import REQUESTS


def read_requests(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A request batch of ``kind`` (a key of ``schemas.REQUESTS``) from Parquet files."""
    return spark.read.schema(REQUESTS[kind]).parquet(path)


def write_requests(df: DataFrame, path: str, kind: str) -> None:
    """Write a request batch, cast to its schema (fails if the folder exists)."""
    from pyspark.sql import functions as F

    schema = REQUESTS[kind]
    df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).write.mode("errorifexists").parquet(path)
