"""Listing projects, what is in one, and its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekwell.functions.formats import size_text
from seekwell.functions.names import EngineError, parse_virtual_path
from seekwell.jobs.config import Config
from seekwell.operators.documents import by_prefix
from seekwell.schemas import SCHEME


def listed(config: Config, spark: SparkSession, default_only: bool = False) -> DataFrame:
    """Projects in the order of the configuration, or those that a search goes by where it names none."""
    rows = config.project_rows(spark)
    return rows.where("default_search") if default_only else rows


def shown(config: Config, counts: DataFrame, name: str) -> DataFrame:
    """A project's settings with its ``counts`` (``statistics.document_counts``), zeros where it has no documents."""
    one = config.project(name).name
    numbers = [c for c in counts.columns if c != "project_name"]
    rows = config.project_rows(counts.sparkSession).where(F.col("project_name") == one)
    whole = rows.join(counts, "project_name", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers})
    return whole.withColumn("size", size_text(F.col("bytes")))


def place(config: Config, text: str) -> tuple[str, str]:
    """Project and path prefix that a text means: a virtual path, a project's name with or without a path, or a file's path."""
    if not (text and text.strip()):
        raise EngineError("INVALID_REQUEST", "a path is needed")
    name, path = parse_virtual_path(text)
    if name in [p.name for p in config.projects]:
        return name, path
    if text.startswith(f"{SCHEME}://"):
        raise EngineError("NOT_FOUND", f"no project {name!r}")
    found = config.locate(text)
    if found is None:
        raise EngineError("NOT_FOUND", f"no project has {text!r}")
    return found[0], "" if found[1] == "." else found[1]


def files(config: Config, docs: DataFrame, text: str) -> DataFrame:
    """Documents of a project at or below a path, which is literal; project and path reach the scan."""
    name, prefix = place(config, text)
    return by_prefix(docs.where(F.col("project_name") == name), prefix)
