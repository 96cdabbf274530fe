"""What the jobs' command lines share: a config file of plain values, flags that override it, a session, a log."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import SparkSession

log = logging.getLogger("quarryline.jobs")


def read_config(spark: SparkSession, path: str) -> dict:
    """One JSON object, from any place that Spark reads."""
    rows = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path).collect()  # a small file
    if len(rows) != 1:
        raise ValueError(f"{path} holds {len(rows)} objects instead of one")
    return {k: v for k, v in rows[0].asDict(recursive=True).items() if v is not None}


def settings(kind: type, config: dict, flags: dict):
    """A dataclass from a config's values and flags that are given; unknown names raise."""
    names = {f.name for f in fields(kind)}
    if unknown := set(config) - names:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**{**config, **{k: v for k, v in flags.items() if v is not None}})


def main(name: str, kind: type, run: Callable[[SparkSession, object], dict], arguments: list[str] | None = None) -> None:
    """Run a job from the command line: --config FILE and a flag for each setting."""
    parser = argparse.ArgumentParser(prog=name, description=run.__doc__)
    parser.add_argument("--config", required=True)
    types = {"int": int, "str": str, "float": float}
    for f in fields(kind):
        parser.add_argument(f"--{f.name}", type=types[f.type])
    flags = vars(parser.parse_args(arguments))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, settings(kind, read_config(spark, flags.pop("config")), flags))
    finally:
        spark.stop()
