"""Counts by project, totals and health warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_counts(docs: DataFrame) -> DataFrame:
    """A row for each project with documents: how many, in which states, of how many bytes."""
    states = (F.count_if(F.col("extraction_status") == s).alias(s) for s in ("ready", "pending", "failed"))
    return docs.groupBy("project_name").agg(F.count("*").alias("documents"), *states, F.coalesce(F.sum("source_size_bytes"), F.lit(0)).alias("bytes"))


def changed_counts(counts: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """``document_counts`` after rows of the registry went and others came, from the counts before.

    Only these rows are read, not the registry. A project whose last document goes has no row.
    """
    names = [c for c in counts.columns if c != "project_name"]
    less = document_counts(gone).select("project_name", *((-F.col(c)).alias(c) for c in names))
    whole = counts.unionByName(less).unionByName(document_counts(new))
    return whole.groupBy("project_name").agg(*(F.sum(c).alias(c) for c in names)).where("documents > 0")


def project_statistics(
    requested: DataFrame, docs: DataFrame, lexical: DataFrame, chunks: DataFrame, embeddings: DataFrame
) -> DataFrame:
    """A row for each requested project, with zeros where it has nothing.

    Chunks count once for every document with the content; they are counted by content before
    documents meet them, so a join has a row a content. The last joins are of a row a project.
    Documents with ``updated_at`` give the last of it.
    """
    by = "project_name"
    parts = [
        docs.groupBy(by).agg(
            F.count("*").alias("documents"),
            *(F.count_if(F.col("extraction_status") == s).alias(s) for s in ("ready", "pending", "failed")),
            F.sum("source_size_bytes").alias("bytes"),
            *([F.max("updated_at").alias("updated_at")] if "updated_at" in docs.columns else []),
        ),
        lexical.groupBy(by).agg(F.count("*").alias("lexical")),
        docs.groupBy(by, "content_hash").agg(F.count("*").alias("_docs"))
        .join(chunks.groupBy("content_hash").agg(F.count("*").alias("_chunks")), "content_hash")
        .groupBy(by)
        .agg(F.sum(F.col("_docs") * F.col("_chunks")).alias("chunks")),
        embeddings.groupBy(by).agg(F.count("*").alias("embeddings"), F.countDistinct("document_id").alias("embedded")),
    ]
    out = requested
    for p in parts:
        out = out.join(p, by, "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in out.columns if c not in (by, "updated_at")]
    return out.select(by, *numbers, *(["updated_at"] if "updated_at" in out.columns else []))


def workspace_warnings(stats: DataFrame, members: DataFrame) -> DataFrame:
    """``(workspace, warning)``: ``NO_PROJECTS`` of one without any, ``NO_DOCUMENTS`` of one whose projects have none.

    ``members(workspace, project_name)`` has a row for each project of a workspace, and one with a null project of one without.
    """
    joined = members.join(stats.select("project_name", "documents"), "project_name", "left")
    totals = joined.groupBy("workspace").agg(F.count("project_name").alias("projects"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"))
    warning = F.when(F.col("projects") == 0, "NO_PROJECTS").when(F.col("documents") == 0, "NO_DOCUMENTS")
    return totals.select("workspace", warning.alias("warning")).where("warning IS NOT NULL")


def scan_report(changes: DataFrame, writes: DataFrame, docs: DataFrame) -> DataFrame:
    """One row of what a scan did (rows upserted, touched, unchanged, removed) and of the states it left."""
    by_change = changes.agg(F.count_if(F.col("change") == "unchanged").alias("unchanged"), F.count_if(F.col("change") == "removed").alias("removed"))
    by_write = writes.agg(F.count_if(F.col("write") == "upsert").alias("upserted"), F.count_if(F.col("write") == "touch").alias("touched"))
    by_state = docs.agg(*(F.count_if(F.col("extraction_status") == s).alias(s) for s in ("ready", "pending", "failed")))
    return by_write.crossJoin(by_change).crossJoin(by_state)


def health_warnings(stats: DataFrame) -> DataFrame:
    """A row for each project and warning."""
    rules = [
        ("NO_DOCUMENTS", F.col("documents") == 0),
        ("PENDING", F.col("pending") > 0),
        ("FAILED", F.col("failed") > 0),
        ("LEXICAL_GAP", F.col("lexical") < F.col("ready")),
        ("NO_CHUNKS", (F.col("ready") > 0) & (F.col("chunks") == 0)),
        ("MISSING_EMBEDDINGS", F.col("embeddings") < F.col("chunks")),
        ("COUNT_MISMATCH", F.col("embeddings") > F.col("chunks")),
    ]
    found = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules)))
    return stats.select("project_name", F.explode(found).alias("warning"))


def totals(stats: DataFrame) -> DataFrame:
    return stats.agg(*(F.sum(c).alias(c) for c in stats.columns if c != "project_name"))
