"""One round of keeping a workspace in step with its folders: scan, extract, chunk, embed, index, publish."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekwell import schemas
from seekwell.functions.names import recipe_id
from seekwell.functions.text import title
from seekwell.jobs.config import Config, Project
from seekwell.operators import embedding, extraction, maintenance
from seekwell.operators.chunking import RECIPE as CHUNK_RULES
from seekwell.operators.chunking import chunked, default_tokens
from seekwell.operators.lexical import inverted, token_index
from seekwell.operators.vector import valid
from seekwell.sources.cache import ProcessingCache, identified
from seekwell.sources.files import contents, listed
from seekwell.sources.snapshots import Snapshot, Workspace

LEXICAL_RECIPE = recipe_id("lexical", "v2", "nfkc", "identifier-split", "cjk-1-3")
KEY = maintenance.KEY
#: Snapshots whose files stay: the new one, and that of readers who began before it.
KEPT_SNAPSHOTS = 2


@dataclass(frozen=True)
class Models:
    """Plug-ins of a sync, each with the name of what made it; a change of name makes its results anew."""

    extract: Callable[[str, str], tuple[str | None, str]] | None = None
    extract_recipes: tuple[tuple[str, str], ...] = ()
    embed: Callable[[list[str]], list[list[float]]] | None = None
    embed_recipe: str = ""
    dims: int = 64
    count: Callable[[str], int] = default_tokens
    most_input: int = 2048

    def recipes(self) -> dict[str, str]:
        """What the results of a sync are made by; chunks go by their rules and by the model that reads them."""
        semantic = recipe_id("semantic", str(self.most_input), self.embed_recipe)
        return {"lexical": LEXICAL_RECIPE, "chunks": recipe_id("chunk", *CHUNK_RULES), "semantic": semantic} | {f"extract.{k}": v for k, v in self.extract_recipes}


def listing(workspace: Workspace, projects: tuple[Project, ...]) -> DataFrame:
    """Files of all projects, by names only."""
    parts = [
        listed(workspace.spark, p.root, p.include, p.exclude, p.ignore_files).select(F.lit(p.name).alias("project_name"), F.lit(p.root).alias("root"), "*")
        for p in projects
    ]
    none = workspace.spark.createDataFrame([], "project_name string, root string, path string, source_mtime_ns long, source_size_bytes long")
    return reduce(DataFrame.unionByName, parts, none)


def registry(files: DataFrame) -> DataFrame:
    """Read files as rows of the document registry, with their bodies."""
    return files.select(
        F.xxhash64(*KEY).alias("document_id"),
        *KEY,
        "source_hash",
        F.sha2("body", 256).alias("content_hash"),
        title(F.coalesce("body", F.lit("")), F.col("path")).alias("title"),
        "source_mtime_ns",
        "source_size_bytes",
        "file_type",
        maintenance.status(F.col("source_hash"), F.col("body")).alias("extraction_status"),
        F.current_timestamp().alias("updated_at"),
        "body",
    )


def sync(workspace: Workspace, projects: Config | dict[str, str], models: Models | None = None, full: bool = False, cache: ProcessingCache | None = None) -> dict[str, int]:
    """Bring a workspace up to date with projects (or name to folder); returns counts of changes.

    What it leaves equals a build from nothing, which ``full`` makes: documents of unlisted projects
    go, contents and chunks that no document has go. Only new and changed files are read, once; only
    contents without chunks are cut, only chunks without embeddings embedded, and only documents
    whose content or title is new get token rows, unless a recipe changed. Only buckets with a
    change are written. Without a model for extraction or embedding its results are kept as long
    as they hold, with their recipes. A ``cache`` is asked before models are, and told what they say.
    """
    config = projects if isinstance(projects, Config) else Config(tuple(Project(n, r) for n, r in sorted(projects.items())))
    models = models or Models()
    with workspace.writing("sync"):
        had = {} if full else workspace.recipes()
        recipes = models.recipes() if models.embed or "semantic" not in had else models.recipes() | {"semantic": had["semantic"]}
        recipes = {k: v for k, v in had.items() if k.startswith("extract.")} | recipes
        same = {k: had.get(k) == v for k, v in recipes.items()}
        cut = same["chunks"] and same["semantic"]
        new = workspace.building()
        if full:
            new.last = None
        old = {t: workspace.read(t) if new.had(t) else None for t in ("documents", "contents", "chunks", "embeddings", "lexical")}
        files = new.step("listing", listing(workspace, config.projects))
        size = files.count()
        docs, found, changes = _scanned(new, files, old["documents"])
        texts = found.where("body IS NOT NULL").select("content_hash", "body").dropDuplicates(["content_hash"])
        if models.extract:
            kinds = [k for group, names in extraction.RECIPE_KINDS.items() if group in dict(models.extract_recipes) for k in names]
            stale = [k for group, names in extraction.RECIPE_KINDS.items() if same.get(f"extract.{group}") is False for k in names]
            waiting = maintenance.invalidated(docs, stale) if stale else docs
            todo = extraction.work(waiting, kinds or list(extraction.RICH)).join(files.select(*KEY, "root"), KEY)
            outcomes = new.step("outcomes", _extracted(new, todo, models, cache))
            docs = extraction.published(waiting, outcomes)
            texts = texts.unionByName(extraction.new_contents(outcomes)).dropDuplicates(["content_hash"])
        docs = new.step("docs", schemas.as_table(docs, schemas.DOCUMENTS))
        hashes = docs.select("content_hash").where("content_hash IS NOT NULL").distinct()
        gone, fresh = maintenance.changes(old["documents"], docs, KEY)
        docs = _stored(new, "documents", KEY, size, docs, gone, fresh, KEY)
        texts = texts.join(hashes, "content_hash", "left_semi")
        dead, lacking = _content_changes(old["contents"], hashes, texts)
        lacking = new.step("texts", schemas.as_table(lacking, schemas.CONTENTS))
        contents_ = _stored(new, "contents", ["content_hash"], size, lacking, dead, lacking, ["content_hash"])
        work = lacking if cut else contents_
        chunks = new.step("chunked", schemas.as_table(chunked(work, models.count, models.most_input), schemas.CHUNKS))
        chunks = _stored(new, "chunks", ["content_hash"], size, chunks, dead, chunks, ["content_hash"], cut)
        if models.embed or old["embeddings"] is not None:
            changes |= _embedded(new, docs, chunks, old["embeddings"] if cut else None, models, size, cache)
        _indexed(new, docs, contents_, old["lexical"] if same["lexical"] else None, size)
        new.publish(recipes)
        workspace.collect(KEPT_SNAPSHOTS)
        return changes


def _stored(new: Snapshot, table: str, on: list[str], size: int, every: DataFrame, gone: DataFrame | None, fresh: DataFrame, by: list[str], keep: bool = True) -> DataFrame:
    """A table changed by what is gone and fresh, or written whole if there is none to change."""
    if keep and new.had(table) and gone is not None:
        return new.change(table, gone, fresh, by)
    return new.whole(table, every, on, size)


def _content_changes(old: DataFrame | None, hashes: DataFrame, texts: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Hashes of contents that no document has any more, and the texts that aren't there yet."""
    if old is None:
        return None, texts
    had = old.select("content_hash")
    return had.join(hashes, "content_hash", "left_anti"), texts.join(had, "content_hash", "left_anti")


def _indexed(new: Snapshot, docs: DataFrame, texts: DataFrame, old: DataFrame | None, size: int) -> None:
    """Token rows and postings of documents whose content or title is new, in place of those that hold no more."""
    order = ["term", *KEY, "col"]
    ready = docs.where("extraction_status = 'ready'")
    if old is None:
        rows = new.whole("lexical", schemas.as_table(token_index(ready.join(texts, "content_hash")), schemas.LEXICAL), KEY, size)
        new.segment("postings", inverted(rows).postings, None, KEY, order)
        return
    known = old.select(*KEY, "content_hash", "title")
    dead = known.join(ready.select(known.columns), known.columns, "left_anti").select(KEY)
    missing = new.step("unindexed", ready.join(known, known.columns, "left_anti"))
    wanted = missing.select("content_hash").distinct()
    # only buckets that have a wanted content are read
    bodies = new.workspace._opened(new.tables["contents"], wanted).join(wanted, "content_hash", "left_semi")
    rows = new.step("tokens", schemas.as_table(token_index(missing.join(bodies, "content_hash")), schemas.LEXICAL))
    gone = new.step("unlisted", dead.unionByName(missing.select(KEY)).distinct())
    new.change("lexical", gone, rows, KEY)
    new.segment("postings", inverted(rows).postings, gone, KEY, order)


def _scanned(new: Snapshot, files: DataFrame, old: DataFrame | None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """The registry after a scan, what was read for it, and counts of changes."""
    if old is None:
        found = new.step("found", registry(contents(files)))
        return found.drop("body"), found, {"added": found.count()}
    diff = new.step("diff", maintenance.diff(old, files))
    changes = {r.change: r["count"] for r in diff.groupBy("change").count().collect()}
    todo = files.join(diff.where("change IN ('added', 'changed')").select(KEY), KEY)
    found = new.step("found", registry(contents(todo)))
    still = old.join(diff.where("change = 'unchanged'").select(KEY), KEY, "left_semi")
    return still.unionByName(maintenance.applied(old, found.drop("body"))), found, changes


def _embedded(new: Snapshot, docs: DataFrame, chunks: DataFrame, old: DataFrame | None, models: Models, size: int, cache: ProcessingCache | None) -> dict[str, int]:
    """Embeddings of all chunks that have none, beside those that still hold; without a model only these."""
    by = ["document_id", "content_hash"]
    kept = docs.sparkSession.createDataFrame([], schemas.EMBEDDINGS) if old is None else embedding.live_embeddings(old, docs)
    dead = None if old is None else old.select(by).join(kept.select(by), by, "left_anti")
    if models.embed is None:
        _stored(new, "embeddings", by[:1], size, kept, dead, kept.limit(0), by)
        return {}
    work = new.step("unembedded", maintenance.embedding_work(docs, chunks, kept))
    wanted = work.select("content_hash").distinct()
    texts = new.workspace._opened(new.tables["chunks"], wanted).select("content_hash", "chunk_index", F.col("body").alias("chunk"))
    named = work.join(docs.select("document_id", "title"), "document_id").join(texts, ["content_hash", "chunk_index"])
    inputs = named.withColumn("input", embedding.document_input(F.col("title"), F.col("chunk")))
    found = new.step("embedded", _with_embeddings(new, inputs, models, cache))
    good = schemas.as_table(found.where("failure IS NULL").drop("failure"), schemas.EMBEDDINGS)
    _stored(new, "embeddings", by[:1], size, good, dead, good, by)
    r = embedding.report(found).first()
    return {"embedded": r.chunks, "embedding_failed": r.failed}


def _extracted(new: Snapshot, todo: DataFrame, models: Models, cache: ProcessingCache | None) -> DataFrame:
    """Outcomes of extraction; of sources whose text the cache has no model is asked."""
    if cache is None:
        return extraction.extracted(todo, models.extract)
    recipes = dict(models.extract_recipes)
    recipe = F.coalesce(*(F.when(F.col("file_type").isin(*kinds), F.lit(recipes.get(group, ""))) for group, kinds in extraction.RECIPE_KINDS.items()), F.lit(""))
    work = new.step("extract_work", identified(todo, F.concat(F.lit("extract."), "file_type"), recipe, F.col("source_hash")))
    known = new.step("extract_hits", cache.hits(work).withColumn("body", F.decode("payload", "UTF-8")).where("body IS NOT NULL"))
    made = new.step("extract_made", extraction.extracted(work.join(known.select(*KEY), KEY, "left_anti"), models.extract))
    cache.put(work.join(made.where("outcome = 'extracted'").select(*KEY, F.encode("body", "UTF-8").alias("payload")), KEY))
    told = known.select(*KEY, F.lit("extracted").alias("outcome"), "body", F.lit(None).cast("string").alias("reason"))
    return told.unionByName(made.select(told.columns))


_VECTOR = "input_token_count int, embedding array<float>"


def _with_embeddings(new: Snapshot, inputs: DataFrame, models: Models, cache: ProcessingCache | None) -> DataFrame:
    """Embeddings of inputs; of inputs that the cache has no model is asked. A kept vector of another size is none."""

    def asked(work: DataFrame) -> DataFrame:
        return embedding.embedded(work, models.embed, models.dims, models.count, models.most_input)

    if cache is None:
        return asked(inputs)
    by = ["document_id", "content_hash", "chunk_index"]
    recipe = F.lit(recipe_id("embed", models.embed_recipe, str(models.dims), str(models.most_input)))
    work = new.step("embed_work", identified(inputs, F.lit("embed"), recipe, F.sha2("input", 256)))
    known = cache.hits(work).withColumn("kept", F.from_json(F.decode("payload", "UTF-8"), _VECTOR))
    known = new.step("embed_hits", known.where(valid("kept.embedding", models.dims)))
    made = new.step("embed_made", asked(work.join(known.select(by), by, "left_anti")))
    good = made.where("failure IS NULL").select(*by, F.encode(F.to_json(F.struct("input_token_count", "embedding")), "UTF-8").alias("payload"))
    cache.put(work.join(good, by))
    none = F.lit(None).cast("string").alias("failure")
    told = known.select("document_id", "project_name", "content_hash", "chunk_index", "kept.input_token_count", "kept.embedding", none)
    return made.select(told.columns).unionByName(told)
