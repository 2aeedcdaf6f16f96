"""Searching a synced workspace: by keywords, by vectors, or both."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekwell.functions.grammar import parse
from seekwell.functions.names import EngineError, virtual_path
from seekwell.jobs.config import Config
from seekwell.operators import feedback, hybrid, lexical, results, vector
from seekwell.operators.context import effective_context
from seekwell.sources.snapshots import Workspace


@dataclass(frozen=True)
class SearchModels:
    """What models a search may ask: embeddings of texts, more inputs for a query, scores of documents.

    Without the last two the corpus takes their place: relevance feedback, and how near each other words are.
    """

    embed: Callable[[list[str]], list[list[float]]]
    expand: Callable[[str], hybrid.Expansion] | None = None
    rerank: Callable[[str, Column], Column] | None = None


def _table(workspace: Workspace, name: str) -> DataFrame:
    found = workspace.read(name)
    if found is None:
        raise EngineError("NOT_READY", f"the workspace has no {name} ({workspace.status()})", "sync it")
    return found


def _questions(workspace: Workspace, texts: dict[int, str], models: SearchModels) -> DataFrame:
    """Embeddings of a few texts, made by the driver in one batch."""
    vectors = models.embed([hybrid.embedding_input(t) for t in texts.values()])
    dims = {len(v) for v in vectors}
    if len(vectors) != len(texts) or len(dims) != 1 or any(x != x or abs(x) == float("inf") for v in vectors for x in v):
        raise EngineError("OPERATION_FAILED", "the embeddings of the queries are incomplete or invalid")
    rows = [(i, [float(x) for x in v]) for i, v in zip(texts, vectors, strict=True)]
    return workspace.spark.createDataFrame(rows, "query_id int, query array<double>")


def search(workspace: Workspace, config: Config, request: hybrid.Request, mode: str, models: SearchModels, projects: list[str] | None = None, traces: list[DataFrame] | None = None) -> DataFrame:
    """Items of a search of the ``mode`` ``lexical``, ``vector`` or ``hybrid``, in the projects that are named or searched by default.

    Ill-formed requests are refused even where there is nothing to search. Vectors that find
    nothing fail the search, as they are missing then; keywords may find nothing. A hybrid search adds a table of its
    steps to ``traces``.
    """
    hybrid.validate(request, mode)
    scope = config.scope(projects)
    docs = _table(workspace, "documents").join(_table(workspace, "contents"), "content_hash").where("extraction_status = 'ready'")
    contexts = config.context_rows(workspace.spark)
    limit = request.limit
    index = lexical.Index(_table(workspace, "postings"), _table(workspace, "lexical").select(*lexical.KEY, "doc_len"))
    if mode == "hybrid":
        wanted = hybrid.candidates(request, models.expand or feedback.from_corpus(index, docs, scope))
        vectors = _vectors(workspace)
        asked = {i: c.text for i, c in enumerate(wanted) if not c.clauses}
        if asked:
            _require(vectors, scope)
            questions = _questions(workspace, asked, models)
        else:
            questions = workspace.spark.createDataFrame([], "query_id int, query array<double>")
        found = hybrid.search(request, wanted, index, vectors, questions, docs, _table(workspace, "chunks"), contexts, scope, models.rerank or hybrid.default_rerank, traces, None if models.rerank else partial(feedback.proximity, index))
        return results.items(found, request).orderBy("final_rank")
    if mode == "vector":
        vectors = _vectors(workspace)
        _require(vectors, scope)
        questions = _questions(workspace, {0: hybrid.with_intent(request.query, request.intent)}, models)
        hits = vector.merged(vector.nearest_documents(vectors, questions, limit, scope), limit).withColumnRenamed("rank", "final_rank")
        chunks = _table(workspace, "chunks").select("content_hash", "chunk_index", F.col("body").alias("evidence"), F.col("char_start_offset").alias("evidence_start"))
        found = hits.join(docs, lexical.KEY).join(chunks, ["content_hash", "chunk_index"], "left")
    else:
        hits = lexical.bm25_topk(index, parse(request.query), limit, scope, docs)
        ranked = hits.withColumn("final_rank", F.row_number().over(lexical.best_first()))
        none = F.lit(None)
        found = ranked.join(docs, lexical.KEY).withColumns({"evidence": none.cast("string"), "evidence_start": none.cast("int")})
    whole = found.withColumn("virtual_path", virtual_path(F.col("project_name"), F.col("path")))
    named = whole.join(effective_context(whole.select(*lexical.KEY), contexts), lexical.KEY)
    return results.items(named, request).orderBy("final_rank")


def _vectors(workspace: Workspace) -> DataFrame:
    """Embeddings with the path of their document."""
    docs = _table(workspace, "documents").select("document_id", "path")
    return _table(workspace, "embeddings").join(docs, "document_id").select("project_name", "path", "chunk_index", "embedding")


def _require(vectors: DataFrame, scope: list[str]) -> None:
    if vectors.where(F.col("project_name").isin(scope)).isEmpty():
        raise EngineError("OPERATION_FAILED", "there are no vectors to search", "sync with an embedding model")
