"""Config files and sessions of the jobs' command lines."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import SparkSession


def load(path: str | Path, defaults: dict) -> dict:
    """The settings of a JSON file over ``defaults``; an unknown name is an error."""
    found = json.loads(Path(path).read_text())
    if unknown := sorted(found.keys() - defaults.keys()):
        raise ValueError(f"{path}: unknown settings {', '.join(unknown)}")
    return defaults | found


def arguments(about: str, config: Path, **paths: str) -> argparse.Namespace:
    """The parsed command line: a required path for each of ``paths`` (name to help), and --config."""
    parser = argparse.ArgumentParser(description=about)
    for name, text in paths.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", default=config, help="JSON file of settings (default: %(default)s)")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return args


def session(name: str) -> SparkSession:
    """Master, memory and the shared folder come from spark-submit or the environment."""
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
