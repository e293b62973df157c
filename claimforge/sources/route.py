"""Routing sources to adapters, extracting each in isolation, and setting failures aside."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.sources.claims import CLAIMS
from claimforge.sources.remote import remote_claims
from claimforge.sources.resume import resume_claims
from claimforge.sources.structured import structured_claims

Extract = Callable[[bytes, str], list[dict]]


@dataclass(frozen=True)
class Adapter:
    """A kind of source: the paths it takes, as a column of a path column, and what it reads from a file."""

    source: str
    can_handle: Callable[[Column], Column]
    extract: Extract


def suffix(path: Column) -> Column:
    """The last suffix of a file name, in lower case, with its dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def _suffixes(*which: str) -> Callable[[Column], Column]:
    return lambda path: suffix(path).isin(*which)


ADAPTERS: list[Adapter] = [
    Adapter("ats", _suffixes(".json"), lambda content, _: structured_claims(content)),
    Adapter("github", _suffixes(".github"), lambda content, _: remote_claims(content)),
    Adapter("resume", _suffixes(".txt", ".pdf", ".docx"), resume_claims),
]


def register_adapter(adapter: Adapter) -> None:
    """Add an adapter after all others."""
    ADAPTERS.append(adapter)


def routed(files: DataFrame, adapters: Iterable[Adapter] | None = None) -> DataFrame:
    """``files`` (…, path) with ``adapter``, the number of the first that takes the path; a check that fails is a no."""
    choice = None
    for i, a in enumerate(ADAPTERS if adapters is None else adapters):
        try:
            takes = F.coalesce(a.can_handle(F.col("path")), F.lit(False))
        except Exception:
            continue
        choice = F.when(takes, F.lit(i)) if choice is None else choice.when(takes, F.lit(i))
    return files.withColumn("adapter", F.lit(None).cast("int") if choice is None else choice)


def read_files(spark: SparkSession, paths: list[str], handles: list[str] = ()) -> DataFrame:
    """(record_id, path, content): files in the order given, then handles as one-line sources. A missing file has no content."""
    # The listing is the caller's own, so it is as small as the call that made it. Spark's readers pass over empty files.
    found = {p for p in paths if _exists(spark, p)}
    order = spark.createDataFrame([(i, p, bytearray() if p in found else None) for i, p in enumerate(paths)], "record_id long, path string, nothing binary")
    named = spark.createDataFrame([(len(paths) + i, f"handle-{i}.github", bytearray(h, "utf-8")) for i, h in enumerate(handles)], "record_id long, path string, content binary")
    if found:
        contents = spark.read.format("binaryFile").load(sorted(found)).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
        order = order.join(contents, "path", "left").select("record_id", "path", F.coalesce("content", "nothing").alias("content"))
    else:
        order = order.withColumnRenamed("nothing", "content")
    return order.unionByName(named)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def extracted(files: DataFrame, adapters: list[Adapter] | None = None) -> DataFrame:
    """``files`` (record_id, path, content) with ``source``, ``claims`` and ``error``; nothing a file holds stops the run."""
    adapters = list(ADAPTERS if adapters is None else adapters)

    @F.pandas_udf(f"struct<claims:{CLAIMS},error:string>")
    def extract(content: pd.Series, path: pd.Series, adapter: pd.Series) -> pd.DataFrame:
        rows = []
        for data, where, which in zip(content, path, adapter, strict=True):
            if pd.isna(which):
                rows.append(([], None))
                continue
            try:
                if data is None:
                    raise FileNotFoundError(where)
                dot = where.rfind(".")
                rows.append((adapters[int(which)].extract(bytes(data), where[dot:] if dot >= 0 else ""), None))
            except Exception as e:
                rows.append(([], f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["claims", "error"])

    names = F.array(*(F.lit(a.source) for a in adapters)) if adapters else F.array(F.lit(None).cast("string"))
    out = routed(files, adapters).withColumn("out", extract("content", "path", "adapter"))
    return out.select("record_id", "path", F.get(names, F.col("adapter")).alias("source"), "out.claims", "out.error")


def claims_of(extracts: DataFrame) -> DataFrame:
    """The claims table, in order of (record_id, claim_seq)."""
    return extracts.where("error is null").select("record_id", F.posexplode("claims").alias("claim_seq", "c")).select("record_id", "claim_seq", "c.*")


def quarantine_of(extracts: DataFrame) -> DataFrame:
    """(record_id, source, path, reason) of what no adapter takes or that failed. A source without claims is neither."""
    reason = F.when(F.col("source").isNull(), F.lit("no_adapter")).otherwise(F.col("error"))
    return extracts.select("record_id", "source", "path", reason.alias("reason")).where("reason is not null")
