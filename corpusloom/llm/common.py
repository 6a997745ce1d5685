"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.joins import BROADCAST_ROWS, HEAVY_KEYS, filter_by_keys, heavy_safe_join, same
from corpusloom.storage import Scratch

__all__ = ["ASCII_SPACE", "BROADCAST_ROWS", "HEAVY_KEYS", "Scratch", "filter_by_keys", "heavy_safe_join", "read_table", "same"]

#: The six bytes ``[\x20\x09-\x0D]`` that count as white space in the contracts.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
