"""Embeddings of chunks: inputs, batches that may fail, and what stays when documents change."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekwell.functions.text import non_blank
from seekwell.operators.chunking import default_tokens

BATCH = 32


def document_input(title: Column, body: Column) -> Column:
    """What a model embeds for a chunk of a document."""
    shown = F.when(non_blank(F.coalesce(title, F.lit(""))), title).otherwise("none")
    return F.concat(F.lit("title: "), shown, F.lit(" | text: "), body)


def hashed_embedding(dims: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in for a model: words count at a place by their hash; unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dims))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = xxhash.xxh64_intdigest(word)
                row[h % dims] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


def embedded(
    work: DataFrame,
    embed: Callable[[list[str]], list[list[float]]],
    dims: int,
    count: Callable[[str], int] = default_tokens,
    most_input: int = 2048,
) -> DataFrame:
    """``work(document_id, project_name, content_hash, chunk_index, input)`` with ``input_token_count``, ``embedding`` and ``failure``.

    Inputs go to the model in batches of 32. A batch that raises, is incomplete, has an input
    over ``most_input`` tokens or gives a vector that isn't ``dims`` finite numbers is left without
    embeddings, and comes again as work next time.
    """

    def one_batch(texts: list[str]) -> list[tuple]:
        counts = [count(t) for t in texts]
        if max(counts) > most_input:
            raise ValueError("an input is longer than the model takes")
        vectors = embed(texts)
        if vectors is None or len(vectors) != len(texts):
            raise ValueError("the batch came back incomplete")
        if any(v is None or len(v) != dims or not np.isfinite(np.asarray(v, np.float64)).all() for v in vectors):
            raise ValueError("a vector is invalid")
        return [(n, [float(x) for x in v], None) for n, v in zip(counts, vectors, strict=True)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in range(0, len(pdf), BATCH):
                some = pdf.iloc[at : at + BATCH]
                try:
                    found = one_batch(some["input"].tolist())
                except Exception as e:
                    found = [(None, None, str(e) or type(e).__name__)] * len(some)
                out = some.drop(columns="input")
                for i, (name, kind) in enumerate((("input_token_count", "Int32"), ("embedding", object), ("failure", object))):
                    out[name] = pd.Series([f[i] for f in found], index=some.index, dtype=kind)
                yield out

    schema = "document_id long, project_name string, content_hash string, chunk_index int, input_token_count int, embedding array<float>, failure string"
    return work.select("document_id", "project_name", "content_hash", "chunk_index", "input").mapInPandas(run, schema)


def report(found: DataFrame) -> DataFrame:
    """One row: documents and chunks that were embedded, and chunks that failed."""
    good = F.col("failure").isNull()
    return found.agg(
        F.count_distinct(F.when(good, F.col("document_id"))).alias("documents"), F.count_if(good).alias("chunks"), F.count_if(~good).alias("failed")
    )


def live_embeddings(embeddings: DataFrame, docs: DataFrame) -> DataFrame:
    """Embeddings whose document is still in its project, ready, and of the same content."""
    key = ["document_id", "project_name", "content_hash"]
    return embeddings.join(docs.where("extraction_status = 'ready'").select(key), key, "left_semi")
