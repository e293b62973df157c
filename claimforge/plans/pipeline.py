"""The whole run: sources to claims, claims to entities, entities to profiles, profiles to views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.operators.fuse import profiles
from claimforge.operators.resolve import cluster
from claimforge.operators.storage import materialize
from claimforge.plans.config import Config
from claimforge.plans.project import project
from claimforge.sources.route import Adapter, claims_of, extracted, quarantine_of, read_files


@dataclass(frozen=True)
class RunResult:
    """Lazy tables of one run; ``views`` has (cluster_id, values, meta, violations), as ``profiles`` by cluster."""

    claims: DataFrame
    profiles: DataFrame
    views: DataFrame
    quarantine: DataFrame


def run_claims(claims: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(profiles, views) of a claims table."""
    found = profiles(cluster(claims))
    return found, project(found, config, ("cluster_id", "candidate_id"))


def run(spark: SparkSession, paths: list[str], config: Config = Config(), handles: list[str] = (), adapters: list[Adapter] | None = None) -> RunResult:
    """Every source is read and parsed once; a bad one ends in ``quarantine``."""
    read = materialize(extracted(read_files(spark, paths, handles), adapters), "extracts")
    claims = claims_of(read)
    found, views = run_claims(claims, config)
    return RunResult(claims, found, views, quarantine_of(read))


def summary(result: RunResult) -> DataFrame:
    """One row: counts and the mean overall confidence, null without profiles."""
    profiled = result.profiles.agg(F.count("*").alias("profiles"), F.avg("overall_confidence").alias("mean_confidence"))
    return profiled.crossJoin(result.quarantine.agg(F.count("*").alias("quarantined")))
