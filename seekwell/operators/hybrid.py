"""Hybrid search: what is asked, rankings of several kinds, evidence, and reranking.

A request is resolved on the driver into a few candidate queries; everything that touches
the corpus is one plan over the index, the vectors and the chunks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekwell.functions.grammar import Clause, normal, parse, plain_terms, text_terms
from seekwell.functions.names import EngineError, virtual_path
from seekwell.functions.text import non_blank
from seekwell.operators import fusion, lexical, vector
from seekwell.operators.context import effective_context
from seekwell.sources.shared import written

#: Most documents that a ranking gives, unless more are asked for.
LEAST_CANDIDATES = 40
QUERY_INPUT = "task: search result | query: "


@dataclass(frozen=True)
class Request:
    """A search: a query, inputs of its own for the branches, and how results look. No limit: all."""

    query: str | None = None
    lex: str | None = None
    vec: str | None = None
    hyde: str | None = None
    intent: str | None = None
    limit: int | None = 20
    full: bool = False
    paths: bool = False
    line_numbers: bool = False

    @property
    def asked(self) -> str:
        """The query, or the first branch input there is: terms and reranking go by it."""
        return next((t for t in (self.query, self.lex, self.vec, self.hyde) if has_text(t)), "")


@dataclass(frozen=True)
class Expansion:
    """What a model adds to a query."""

    lex: tuple[str, ...] = ()
    vec: tuple[str, ...] = ()
    hyde: tuple[str, ...] = ()


@dataclass(frozen=True)
class Candidate:
    """A query of one ranking: by keywords if it has clauses, else by the embedding of its text."""

    kind: str
    weight: float
    text: str
    clauses: tuple[Clause, ...] = ()


def has_text(text: str | None) -> bool:
    return bool(text and text.strip())


def validate(request: Request, mode: str) -> None:
    """Refuse what no search can answer; keyword queries are parsed even if nothing will be searched."""
    if request.limit is not None and request.limit < 1:
        raise EngineError("INVALID_REQUEST", "a limit is at least 1")
    if request.paths and (request.full or request.line_numbers):
        raise EngineError("INVALID_REQUEST", "paths have no text to show")
    if mode == "hybrid":
        if not request.asked:
            raise EngineError("INVALID_REQUEST", "a query or an input is needed")
        for text in filter(has_text, (request.query, request.lex)):
            parse(text)
    elif not has_text(request.query):
        raise EngineError("INVALID_REQUEST", "a query is needed")
    elif mode == "lexical":
        parse(request.query)


def with_intent(text: str, intent: str | None) -> str:
    return f"{text}\nQuery intent: {intent}" if has_text(intent) else text


def _unlike(inputs: tuple[str, ...], query: str | None) -> list[str]:
    """Inputs that differ from the query and from each other in more than case and form."""
    seen, out = {normal(query or "").strip().lower()}, []
    for text in (t.strip() for t in inputs if has_text(t)):
        if (name := normal(text).lower()) not in seen:
            seen.add(name)
            out.append(text)
    return out


def candidates(request: Request, expand: Callable[[str], Expansion] | None = None) -> list[Candidate]:
    """The rankings to make, keywords first. The query counts twice as much as other inputs.

    Branches without an input of their own are expanded from the query, and have to come out
    with something. Keywords that an expansion wrote and that are no valid query are words.
    """
    given = {"lex": request.lex, "vec": request.vec, "hyde": request.hyde}
    more = Expansion()
    if has_text(request.query) and not all(map(has_text, given.values())):
        more = (expand(with_intent(request.query, request.intent)) if expand else None) or Expansion()
    inputs = {k: [v.strip()] if has_text(v) else _unlike(getattr(more, k), request.query) for k, v in given.items()}
    if has_text(request.query) and (missing := [k for k, v in inputs.items() if not v]):
        raise EngineError("OPERATION_FAILED", f"the expansion has no {', '.join(missing)}", "give these inputs")
    asked = [request.query] if has_text(request.query) else []

    def words(text: str, own: bool) -> tuple[Clause, ...]:
        try:
            return tuple(parse(text))
        except EngineError:
            if own:
                raise
            return tuple(Clause(w) for w in text_terms(text))

    out = [Candidate("query", 2.0, t, words(t, True)) for t in asked]
    out += [Candidate("lex", 1.0, t, words(t, has_text(request.lex))) for t in inputs["lex"]]
    out += [Candidate("query", 2.0, with_intent(t, request.intent)) for t in asked]
    for kind in ("vec", "hyde"):
        own = has_text(given[kind])
        out += [Candidate(kind, 1.0, with_intent(t, request.intent) if own else t) for t in inputs[kind]]
    return out


def embedding_input(text: str) -> str:
    """How a model is asked for the embedding of a query."""
    return QUERY_INPUT + text


def candidate_limit(limit: int | None) -> int | None:
    return None if limit is None else max(limit, LEAST_CANDIDATES)


def rankings(
    wanted: list[Candidate],
    index: lexical.Index,
    vectors: DataFrame,
    questions: DataFrame,
    bodies: DataFrame,
    limit: int | None,
    scope: list[str] | None = None,
) -> DataFrame:
    """``(query_no, kind, weight, project_name, path, chunk_index, order)`` of all rankings.

    ``questions(query_id, query)`` has the embeddings of the queries without clauses, by their
    number in ``wanted``. Hits of keywords have no chunk.
    """
    most = candidate_limit(limit)
    parts = []
    for no, c in enumerate(wanted):
        if c.clauses:
            hits = lexical.bm25_topk(index, list(c.clauses), most, scope, bodies)
            parts.append(hits.select(F.lit(no).alias("query_no"), *lexical.KEY, F.lit(None).cast("int").alias("chunk_index"), F.col("raw_bm25").alias("order")))
    if any(not c.clauses for c in wanted):
        near = vector.merged(vector.nearest_documents(vectors, questions, most, scope), most)
        parts.append(near.select(F.col("query_id").cast("int").alias("query_no"), *lexical.KEY, "chunk_index", (-F.col("score")).alias("order")))
    weights = F.element_at(F.array(*(F.lit(c.weight) for c in wanted)), F.col("query_no") + 1)
    kinds = F.element_at(F.array(*(F.lit(c.kind) for c in wanted)), F.col("query_no") + 1)
    return reduce(DataFrame.unionByName, parts).withColumns({"weight": weights, "kind": kinds})


def fused(found: DataFrame, docs: DataFrame, limit: int | None = None) -> DataFrame:
    """Rankings fused into ``(virtual_path, ..., fusion_score, fusion_rank, chunk_index)`` with the document's columns.

    ``docs(project_name, path, content_hash, body, ...)``. Blank documents are left out before
    ranks are counted. The hit that stands for a document is its first with a chunk, or its
    first.
    """
    path = virtual_path(F.col("project_name"), F.col("path"))
    hits = found.join(docs.where(non_blank(F.col("body"))), lexical.KEY).withColumn("virtual_path", path)
    ranked = fusion.ranked(hits.withColumn("query_id", F.col("query_no")), [F.col("order"), F.col("virtual_path")])
    chosen = ranked.groupBy("virtual_path").agg(
        F.min_by(F.struct("chunk_index", *docs.columns), F.struct(F.col("chunk_index").isNull(), "query_no", "rank")).alias("hit")
    )
    return fusion.fused(ranked, candidate_limit(limit)).join(chosen, "virtual_path").select("*", "hit.*").drop("hit")


def with_evidence(ranked: DataFrame, chunks: DataFrame | Callable[[DataFrame], DataFrame], request: Request, depth: int = fusion.RERANK_DEPTH) -> DataFrame:
    """Adds ``evidence`` and ``evidence_start`` to the first ``depth`` of fused documents, null to others.

    The evidence is the hit's own chunk, or the chunk with most of the query's terms and half as
    much of the intent's. A document whose chunks are missing fails the search. ``chunks`` may be a function that
    makes those of the contents in a table ``(content_hash)``, so that no others are made.
    """
    first = ranked.where(F.col("fusion_rank") <= depth)
    terms = [(t, 1.0) for t in plain_terms(request.asked)] + [(t, 0.5) for t in text_terms(request.intent)]
    if callable(chunks):
        chunks = chunks(first.select("content_hash").distinct())
    named = chunks.select("content_hash", F.col("chunk_index").alias("_chunk"), F.col("body").alias("_text"), "char_start_offset")
    pairs = first.select("virtual_path", "content_hash", "chunk_index").join(named, "content_hash")
    own = F.col("chunk_index") == F.col("_chunk")
    best = pairs.where(F.col("chunk_index").isNull() | own).groupBy("virtual_path").agg(
        F.max_by(F.struct("_text", "char_start_offset"), F.struct(fusion.term_score(F.col("_text"), terms), -F.col("_chunk"))).alias("_best")
    )
    missing = F.raise_error(F.lit("chunks are missing for evidence: sync, then search again")).cast("string")
    text = F.when(F.col("fusion_rank") > depth, None).when(F.col("_best").isNull(), missing).otherwise(F.col("_best._text"))
    return ranked.join(best, "virtual_path", "left").select(
        *ranked.columns, text.alias("evidence"), F.col("_best.char_start_offset").alias("evidence_start")
    )


def rerank_query(request: Request) -> str:
    return f"{request.intent}\n\n{request.asked}" if has_text(request.intent) else request.asked


def rerank_document(context: Column, evidence: Column) -> Column:
    shown = F.concat(F.lit("Context:\n"), context, F.lit("\n\nDocument excerpt:\n"), evidence)
    return F.when(non_blank(context), shown).otherwise(evidence)


def checked_score(score: Column) -> Column:
    """A reranker's score, which must be a finite number."""
    bad = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("a reranker's score is no number")).cast("double")).otherwise(score)


def default_rerank(query: str, document: Column) -> Column:
    """A stand-in for a model: the share of the query's terms that a document has."""
    return fusion.term_overlap(document, plain_terms(query))


def search(
    request: Request,
    wanted: list[Candidate],
    index: lexical.Index,
    vectors: DataFrame,
    questions: DataFrame,
    docs: DataFrame,
    chunks: DataFrame | Callable[[DataFrame], DataFrame],
    contexts: DataFrame,
    scope: list[str] | None = None,
    rerank: Callable[[str, Column], Column] = default_rerank,
    traces: list[DataFrame] | None = None,
    closeness: Callable[[str, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Matches of a hybrid search in final order: ``final_rank``, ``score``, evidence and context of each.

    An empty scope finds nothing. Rankings and what they fuse into are few rows, which are written
    once, as several later steps read them. ``traces`` gets what led to the result (``traced``). With ``closeness``,
    documents are reranked by what it says of them (``feedback.proximity``), not by ``rerank``.
    """
    found = written(rankings(wanted, index, vectors, questions, docs, request.limit, scope))
    first = written(fused(found, docs, request.limit))
    if traces is not None:
        traces.append(traced(found, first))
    ranked = written(with_evidence(first, chunks, request))
    context = effective_context(ranked.select(*lexical.KEY), contexts)
    whole = ranked.join(context, lexical.KEY)
    if closeness is None:
        scores = checked_score(rerank(rerank_query(request), rerank_document(F.col("context"), F.col("evidence"))))
    else:
        near = closeness(rerank_query(request), first.where(F.col("fusion_rank") <= fusion.RERANK_DEPTH).select(*lexical.KEY))
        whole, scores = whole.join(near.select(*lexical.KEY, "closeness"), lexical.KEY, "left"), F.coalesce("closeness", F.lit(0.0))
    scored = whole.withColumn("rerank", F.when(F.col("fusion_rank") <= fusion.RERANK_DEPTH, scores))
    out = fusion.blended(scored.drop("closeness"))
    return out if request.limit is None else out.where(F.col("final_rank") <= request.limit)


def traced(found: DataFrame, ranked: DataFrame) -> DataFrame:
    """What led to a result: the first three hits of each ranking and the first five of the fusion."""
    each = fusion.ranked(
        found.withColumn("query_id", F.col("query_no")).withColumn("virtual_path", virtual_path(F.col("project_name"), F.col("path"))),
        [F.col("order"), F.col("virtual_path")],
    ).where("rank <= 3")
    steps = each.select(F.concat(F.lit("ranking "), F.col("query_no").cast("string")).alias("step"), "rank", "virtual_path", F.col("order").cast("double").alias("value"))
    top = ranked.where("fusion_rank <= 5").select(F.lit("fusion").alias("step"), F.col("fusion_rank").alias("rank"), "virtual_path", F.col("fusion_score").alias("value"))
    return steps.unionByName(top)
