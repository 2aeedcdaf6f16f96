"""The tables of a workspace, and how driver tables map onto them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEME = "doc"
FILE_TYPES = ("text", "pdf", "image", "audio", "video", "other")
STATUSES = ("ready", "pending", "failed")

DOCUMENTS = (
    "document_id long, project_name string, path string, source_hash string, content_hash string, title string, "
    "source_mtime_ns long, source_size_bytes long, file_type string, extraction_status string, updated_at timestamp"
)
CONTENTS = "content_hash string, body string"
CHUNKS = "content_hash string, chunk_index int, char_start_offset int, char_end_offset int, body string, token_count int"
EMBEDDINGS = (
    "document_id long, project_name string, content_hash string, chunk_index int, input_token_count int, embedding array<float>"
)
LEXICAL = (
    "project_name string, path string, content_hash string, title string, title_tokens array<string>, body_tokens array<string>, doc_len int"
)
#: Tables with other columns are not read, but made anew.
SCHEMA_ID = hashlib.sha256("|".join((DOCUMENTS, CONTENTS, CHUNKS, EMBEDDINGS, LEXICAL)).encode()).hexdigest()


def as_table(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a table, in its order and of its types."""
    parts = [c.rsplit(" ", 1) for c in schema.split(", ")]
    return df.select(*(F.col(name).cast(kind).alias(name) for name, kind in parts))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a registry: the language is the project, source and id make the path."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("lang").alias("project_name"),
        F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt")).alias("path"),
        F.col("text").alias("body"),
        F.sha2("text", 256).alias("content_hash"),
    )
