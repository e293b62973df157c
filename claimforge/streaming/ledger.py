"""The claims ledger: an append-only table, fed by batches or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from claimforge.sources.claims import TABLE


def append(claims: DataFrame, path: str) -> None:
    """Add claims; what is there is never changed."""
    claims.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All claims so far."""
    return spark.read.schema(TABLE).parquet(path)


def follow(claims: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of claims, each exactly once; the caller stops the query or lets it drain."""
    return claims.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
