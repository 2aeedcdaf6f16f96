"""What a search or a lookup shows: paths, snippets or whole bodies, with lines and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekwell.functions.grammar import plain_terms, text_terms
from seekwell.functions.names import EngineError, csv_cell, doc_id, glob_regex, parse_virtual_path, score_text, valid_path
from seekwell.functions.text import lines, nfkc, non_blank, numbered, snippet
from seekwell.operators.documents import guarded_body, line_range
from seekwell.operators.hybrid import Request
from seekwell.schemas import SCHEME

INTENT_WEIGHT, CONTEXT_WEIGHT = 0.3, 0.15


def line_at(body: Column, offset: Column) -> Column:
    """The line, from 1, of an offset into a text."""
    return F.regexp_count(F.substring(body, F.lit(1), F.coalesce(offset, F.lit(0))), F.lit("\n")) + 1


def context_words(context: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(nfkc(context)), '"', ""), "-", " ")
    return F.filter(F.split(plain, r"\s+"), lambda t: t != "")


def best_line(rows: Column, request: Request, context_words: Column) -> Column:
    """Zero-based line with most terms of the query, and less so of the intent and the context.

    ``rows`` are lines in compatibility form and small letters.
    """
    fixed = [(t, 1.0) for t in plain_terms(request.asked)] + [(t, INTENT_WEIGHT) for t in text_terms(request.intent)]

    def score(line: Column) -> Column:
        own = sum((F.when(line.contains(t), F.lit(w)).otherwise(0.0) for t, w in fixed), F.lit(0.0))
        return own + CONTEXT_WEIGHT * F.size(F.filter(context_words, lambda t: line.contains(t)))

    scored = F.transform(rows, lambda x, i: F.struct(score(x).alias("score"), (-i).alias("back")))
    return -F.array_max(scored)["back"]


def items(matches: DataFrame, request: Request) -> DataFrame:
    """``(final_rank, id, virtual_path, title, score, snippet, body, line, context)`` of matches.

    ``matches`` have the document's columns, ``evidence`` (null: the body), ``evidence_start`` (null:
    the text's start) and ``context``. Paths have no text; whole bodies no snippet. Lines
    count in the document, so a snippet's numbers go on from where its evidence begins.
    """
    fixed = [F.col("final_rank"), doc_id(F.col("content_hash")).alias("id"), F.col("virtual_path"), F.col("title"), F.col("score")]
    none = F.lit(None)
    if request.paths:
        return matches.select(*fixed, F.lit("").alias("snippet"), none.cast("string").alias("body"), none.cast("int").alias("line"), "context")
    source = F.when(non_blank(F.coalesce("evidence", F.lit(""))), F.col("evidence")).otherwise(F.coalesce("body", F.lit("")))
    # a generator of one row keeps the Python function out of the expressions that go over lines
    parts = F.struct(
        lines(source).alias("_lines"), lines(F.lower(nfkc(source))).alias("_plain"), context_words(F.col("context")).alias("_words")
    )
    at = (
        matches.select(*matches.columns, F.inline(F.array(parts)))
        .withColumn("_best", best_line(F.col("_plain"), request, F.col("_words")))
        .withColumn("_first", line_at(F.col("body"), F.col("evidence_start")))
    )
    line = (F.col("_first") + F.col("_best")).cast("int").alias("line")
    if request.full:
        body = F.array_join(numbered(lines(F.col("body"))), "\n") if request.line_numbers else F.coalesce("body", F.lit(""))
        return at.select(*fixed, F.lit("").alias("snippet"), body.alias("body"), line, "context")
    text = snippet(F.col("_lines"), F.col("_best"))
    shown = F.array_join(numbered(lines(text), F.col("_first") + F.greatest(F.col("_best") - 1, F.lit(0))), "\n") if request.line_numbers else text
    return at.select(*fixed, shown.alias("snippet"), none.cast("string").alias("body"), line, "context")


def resolved(docs: DataFrame, targets: list[str], projects: dict[str, str]) -> DataFrame:
    """``(target, kind, project_name, path, found)``: what each target of a lookup names.

    A target is an id, a virtual path or glob, a path that begins with a project's name, or a
    file below a project's folder, in this order; ``projects`` are names and folders, and the
    first folder that has a file decides. An id that several paths have names all of them, as does a
    glob; callers tell an ambiguous id by its number of rows. A target that names nothing
    has one row without a path.
    """
    tags = []
    for at, target in enumerate(targets):
        if target.startswith("@"):
            kind, hit = "id", doc_id(F.col("content_hash")) == target.lower()
            hit = hit & (F.col("extraction_status") == "ready")
        else:
            project, path = _project_and_path(target, projects)
            kind = "glob" if any(c in path for c in "*?") else "path"
            hit = F.col("path").rlike(glob_regex(path)) if kind == "glob" else F.col("path") == path
            hit = (F.col("project_name") == project) & hit
        tags.append(F.when(hit, F.struct(F.lit(at).alias("at"), F.lit(kind).alias("kind"))))
    asked = docs.sparkSession.createDataFrame(list(enumerate(targets)), "at int, target string")
    # the documents are read once, whatever the number of targets
    every = docs.select("project_name", "path", F.inline(F.array_compact(F.array(*tags))))
    return asked.join(every, "at", "left").select("at", "target", "kind", "project_name", "path")


def _project_and_path(target: str, projects: dict[str, str]) -> tuple[str, str]:
    name, path = parse_virtual_path(target)
    if target.startswith(f"{SCHEME}://") or (name in projects and path):
        if not any(c in path for c in "*?") and not valid_path(path):
            raise EngineError("INVALID_REQUEST", f"no path of a document: {target!r}")
        return name, path
    for project, root in projects.items():
        if target.startswith(root.rstrip("/") + "/"):
            return project, target[len(root.rstrip("/")) + 1 :]
    return name, path


def got(docs: DataFrame, found: DataFrame, most_bytes: int, start: int = 1, count: int | None = None, paths: bool = False) -> DataFrame:
    """``(target, virtual_path, state, body)`` of what a lookup names.

    States: ``ok``; ``ambiguous`` for an id of several paths; ``missing``; ``not_ready``; ``skipped``
    for a body over ``most_bytes``, which is no failure. Only ``ok`` has a body, and paths have none.
    """
    several = found.where("kind = 'id'").groupBy("at").agg((F.count("*") > 1).alias("several"))
    size = F.octet_length("body")
    state = (
        F.when(F.col("path").isNull(), "missing")
        .when(F.coalesce("several", F.lit(False)), "ambiguous")
        .when(F.col("extraction_status") != "ready", "not_ready")
        .when(F.lit(not paths) & (size > most_bytes), "skipped")
        .otherwise("ok")
    )
    body = F.lit(None).cast("string") if paths else line_range(guarded_body(F.col("body"), most_bytes), start, count)
    joined = found.join(docs.select("project_name", "path", "extraction_status", "body"), ["project_name", "path"], "left").join(several, "at", "left")
    path = F.concat(F.lit(f"{SCHEME}://"), "project_name", F.lit("/"), "path")
    return joined.select("at", "target", path.alias("virtual_path"), state.alias("state"), "body").withColumn("body", F.when(F.col("state") == "ok", body)).orderBy("at", "virtual_path")


def exit_code(states: list[str]) -> int:
    """0 if all that was asked for came out, 3 if some did, 1 if none did."""
    good = sum(s in ("ok", "skipped") for s in states)
    return 0 if good == len(states) else 3 if good else 1


def rendered(rows: list, form: str) -> str:
    """A limited result as ``text``, ``csv``, ``md`` or ``paths``; JSON is ``toJSON`` of the frame."""
    if form == "paths":
        return "\n".join(r.virtual_path for r in rows)
    if form == "csv":
        head = ("id", "virtual_path", "title", "score", "line", "snippet")
        cells = [[r.id, r.virtual_path, r.title, score_text(r.score), r.line, r.snippet or r.body] for r in rows]
        return "\n".join(",".join(map(csv_cell, row)) for row in [head, *cells])
    if form == "md":
        return "\n\n".join(f"## {r.title}\n\n`{r.virtual_path}` {r.id} ({score_text(r.score)})\n\n{r.body or r.snippet}" for r in rows)
    return "\n\n".join(f"{r.virtual_path}:{r.line or 1} {r.id} {score_text(r.score)}\n{r.body or r.snippet}" for r in rows)
