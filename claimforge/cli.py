"""Command line: sources in, views as JSON out."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from claimforge.plans.config import ConfigError, load_config
from claimforge.plans.pipeline import RunResult, run, summary

VERSION = "0.1.0"


def response(result: RunResult) -> dict:
    """The result of a run as one JSON document: for calls whose sources a person lists, so it fits the driver."""
    views = result.views.join(result.profiles.select("cluster_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("profile")), "cluster_id")
    rows = views.orderBy("cluster_id").select("profile", F.to_json("values").alias("values"), F.to_json("meta").alias("meta"), F.to_json("violations", {"ignoreNullFields": "false"}).alias("violations")).collect()
    whole = summary(result).first()
    out = []
    for r in rows:
        profile = json.loads(r["profile"])
        profile.pop("cluster_id")
        wrong = json.loads(r["violations"])
        out.append({"profile": profile, "values": json.loads(r["values"]), "meta": json.loads(r["meta"]), "report": {"ok": not wrong, "violations": wrong}})
    aside = [q.asDict() for q in result.quarantine.orderBy("record_id").drop("record_id").collect()]
    return {"results": out, "quarantine": aside, "summary": whole.asDict()}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="claimforge", description="Fuse records of several sources into one profile per entity.")
    p.add_argument("--inputs", nargs="*", default=[], help="source files")
    p.add_argument("--github", nargs="*", default=[], help="handles of remote profiles")
    p.add_argument("--config", default=None, help="projection as a JSON file, or none")
    p.add_argument("--out", default=None, help="file to write to, instead of standard output")
    p.add_argument("--version", action="version", version=VERSION)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if not args.inputs and not args.github:
        parser().error("give --inputs or --github")
    try:
        config = load_config(args.config)
    except (ConfigError, OSError) as e:
        raise SystemExit(f"bad configuration: {e}") from e
    spark = SparkSession.builder.appName("claimforge").getOrCreate()
    text = json.dumps(response(run(spark, args.inputs, config, args.github)), indent=2, ensure_ascii=False)
    if args.out:
        with open(args.out, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
