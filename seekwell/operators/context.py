"""Texts that describe a project or a folder, joined for the documents below it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ancestors(path: str = "path"):
    """``/`` and every folder of a path, and the path itself, each with a leading slash."""
    parts = F.split(path, "/")
    deep = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    return F.concat(F.array(F.lit("/")), deep)


def effective_context(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """``docs(project_name, path)`` to ``(project_name, path, context)``.

    ``contexts(project, path, text, position)``; a null project holds for all. A path holds for
    itself and what is below. Every ancestor is a key, with its project or without, so the prefix join is two equi-joins.
    Texts go global first, then by length of path, then as configured, with a blank line
    between; documents without any have an empty context.
    """
    keys = docs.select("project_name", "path").distinct().withColumn("_at", F.explode(ancestors()))
    named = contexts.select("project", F.col("path").alias("_at"), "text", "position")
    own = keys.join(named.where("project IS NOT NULL").withColumn("project_name", F.col("project")), ["project_name", "_at"])
    found = own.unionByName(keys.join(named.where("project IS NULL"), "_at"))
    texts = found.groupBy("project_name", "path").agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("project").isNotNull().alias("own"), F.length("_at").alias("n"), "position", "text"))
        ).alias("all")
    ).select("project_name", "path", F.array_join(F.transform("all", lambda x: x["text"]), "\n\n").alias("context"))
    return docs.select("project_name", "path").distinct().join(texts, ["project_name", "path"], "left").select(
        "project_name", "path", F.coalesce("context", F.lit("")).alias("context")
    )
