"""What the jobs share: the session and the arguments that all of them take."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def arguments(text: str, *paths: str) -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description=text)
    for p in paths:
        parser.add_argument(p)
    parser.add_argument("--seed", type=int, default=0)
    return parser


def session(name: str) -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
