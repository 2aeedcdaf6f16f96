"""Snapshots that share files, segments of postings, and rounds that keep what they don't make."""

import hashlib
import os
import random

from pyspark.sql import functions as F

from seekwell.functions.grammar import parse
from seekwell.functions.names import recipe_id
from seekwell.jobs import config, indexing
from seekwell.jobs.sync import Models, sync
from seekwell.operators import embedding, lexical, segments, statistics
from seekwell.sources.cache import ProcessingCache, identified
from seekwell.sources.snapshots import Workspace
from seekwell.streaming.resync import resync

ROW = "project_name string, path string, body string"


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_a_change_of_one_row_writes_one_bucket(spark, tmp_path):
    r = random.Random(1)
    rows = {("p", f"d{i}"): " ".join(str(r.random()) for _ in range(20)) for i in range(10_000)}
    table = lambda some: spark.createDataFrame([(*k, b) for k, b in some.items()], ROW)
    space = Workspace(spark, str(tmp_path), bucket_rows=50)
    first = space.building()
    first.whole("t", table(rows), lexical.KEY, len(rows))
    first.publish({})
    before = size_of(tmp_path / "data")
    changed = {("p", "d77"): "other"}
    second = space.building()
    second.change("t", table(changed), table(changed), lexical.KEY)
    second.publish({})
    assert size_of(tmp_path / "data") - before < before / 100
    assert rows_of(space.read("t")) == rows_of(table(rows | changed))
    some = table({k: rows[k] for k in [("p", "d1"), ("p", "d2")]})
    near = space.read("t", some)
    assert set(rows_of(some)) <= set(rows_of(near)) and near.count() < 400
    third = space.building()  # a row goes, another comes, nothing else is asked
    third.change("t", table({("p", "d3"): ""}), table({("q", "new"): "x"}), lexical.KEY)
    third.publish({})
    want = {k: v for k, v in (rows | changed | {("q", "new"): "x"}).items() if k != ("p", "d3")}
    assert rows_of(space.read("t")) == rows_of(table(want))
    held = size_of(tmp_path / "data")
    assert space.collect(1) > 0 and size_of(tmp_path / "data") < held
    assert rows_of(space.read("t")) == rows_of(table(want)) and len(os.listdir(tmp_path / "manifests")) >= 1
    last = space.building()
    last.change("t", table(want), table({}), lexical.KEY)
    last.publish({})
    assert space.read("t").count() == 0 and not os.listdir(tmp_path / "steps")


def test_segments_hold_what_a_rebuild_holds(spark, tmp_path):
    r = random.Random(2)
    space, state = Workspace(spark, str(tmp_path)), {}
    table = lambda some: spark.createDataFrame([(*k, b) for k, b in some.items()], ROW)
    counts = []
    for step in range(6):
        gone = r.sample(sorted(state), min(len(state), 3)) if step else []
        new = {("p", f"d{r.randrange(60)}"): f"{step} {r.random()}" for _ in range(40 if not step else 4)}
        state = {k: v for k, v in state.items() if k not in gone} | new
        made = space.building()
        made.tables = dict(made.last["tables"]) if made.last else {}
        dead = table({k: "" for k in [*gone, *new]}).select(lexical.KEY) if step else None
        made.segment("t", table(new), dead, lexical.KEY, lexical.KEY)
        made.publish({})
        counts.append(len(space.current()["tables"]["t"]["segments"]))
        assert rows_of(space.read("t")) == rows_of(table(state))
    assert max(counts) > 1 and max(counts) <= 4


def test_sizes_of_segments_fall():
    assert segments.tail([10]) == 0 and segments.tail([100, 10]) == 1 and segments.tail([100, 25]) == 0
    assert segments.tail([1000, 100, 20, 6]) == 1 and segments.tail([1000, 240, 40, 9]) == 3


def searchable(space):
    return lexical.Index(space.read("postings"), space.read("lexical").select(*lexical.KEY, "doc_len"))


def test_a_round_without_models_keeps_their_results_and_the_configuration(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    for name in ("a.md", "b.md", "c.md", "noise.log"):
        (root / name).write_text(f"# {name}\n\nrate limit of {name}\n")
    (root / "scan.pdf").write_bytes(b"%PDF-1.7 x")
    setup = config.Config((config.Project("p", str(root), exclude=("*.log",)),))
    models = Models(lambda path, kind: ("extracted rate", hashlib.sha256(open(path, "rb").read()).hexdigest()), (("pdf", "v1"),), embedding.hashed_embedding(8), "hashed", 8)
    space = Workspace(spark, str(tmp_path / "w"))
    sync(space, setup, models)
    tables = ("documents", "contents", "chunks", "embeddings", "lexical", "postings")
    state = lambda: {t: rows_of(space.read(t).drop("updated_at")) for t in tables}
    before = state()
    assert len(before["documents"]) == 4 and len(before["embeddings"]) == 4
    resync(space, setup, str(tmp_path / "c1"), models=models).awaitTermination(120)
    assert state() == before
    assert sync(space, setup) == {"unchanged": 4} and state() == before  # without any model
    (root / "a.md").unlink()
    (root / "b.md").write_text("# b\n\nother words\n")
    assert sync(space, setup) == {"unchanged": 2, "changed": 1, "removed": 1}
    assert len(space.read("embeddings").collect()) == 2  # of what is still as it was
    hits = lexical.bm25_topk(searchable(space), parse("rate"), None).collect()
    assert {h.path for h in hits} == {"c.md", "scan.pdf"}
    sync(space, setup, models)
    fresh = Workspace(spark, str(tmp_path / "fresh"))
    sync(fresh, setup, models)
    for t in tables:
        assert rows_of(space.read(t).drop("updated_at")) == rows_of(fresh.read(t).drop("updated_at")), t


def test_an_index_follows_its_table(spark, tmp_path):
    def write(word):
        rows = [(i, f"{word} number {i}", "en", "s", 1) for i in range(20)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))

    found = lambda word: lexical.bm25_topk(indexing.keyword_index(spark, str(tmp_path)), parse(word), None).count()
    write("alpha")
    assert found("alpha") == 20 and found("gamma") == 0
    write("gamma")
    assert found("alpha") == 0 and found("gamma") == 20


def test_a_second_build_from_nothing_asks_no_model(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    for name in ("a.md", "b.md"):
        (root / name).write_text(f"# {name}\n\nrate limit of {name}\n")
    (root / "scan.pdf").write_bytes(b"%PDF-1.7 x")
    asked = tmp_path / "asked"
    asked.mkdir()

    def told(kind):
        (asked / f"{kind}-{os.urandom(8).hex()}").write_text("")

    def extract(path, kind):
        told("extract")
        return "extracted rate", hashlib.sha256(open(path, "rb").read()).hexdigest()

    def embed(texts):
        told("embed")
        return embedding.hashed_embedding(8)(texts)

    models = Models(extract, (("pdf", "v1"),), embed, "e1", 8)
    cache = ProcessingCache(spark, str(tmp_path / "cache"))
    spaces = [Workspace(spark, str(tmp_path / name)) for name in ("one", "two", "three")]
    sync(spaces[0], {"p": str(root)}, models, cache=cache)
    assert len(os.listdir(asked)) >= 2 and cache.table().count() == 4
    for f in os.listdir(asked):
        os.remove(asked / f)
    assert sync(spaces[1], {"p": str(root)}, models, cache=cache) == {"added": 3, "embedded": 3, "embedding_failed": 0}
    assert not os.listdir(asked)
    for t in ("documents", "contents", "chunks", "embeddings", "postings"):
        assert rows_of(spaces[1].read(t).drop("updated_at")) == rows_of(spaces[0].read(t).drop("updated_at")), t
    (tmp_path / "cache" / "CURRENT").write_text("{broken")  # a broken cache has nothing, and fails nothing
    assert sync(spaces[2], {"p": str(root)}, models, cache=cache)["embedded"] == 3
    assert os.listdir(asked)


def test_a_cache_checks_identity_replaces_and_evicts(spark, tmp_path):
    now = [100]
    cache = ProcessingCache(spark, str(tmp_path), cap=5, keep=3, cheap=("cheap",), clock=lambda: now[0])

    def work(*rows):
        return identified(spark.createDataFrame(list(rows), "op string, r string, h string, payload binary"), F.col("op"), F.col("r"), F.col("h")).drop("op", "r", "h")

    found = lambda *rows: {(x.operation, x.recipe_id, x.input_hash): bytes(x.payload) for x in cache.hits(work(*((*r, None) for r in rows)).drop("payload")).collect()}
    assert found(("cheap", "r", "1")) == {}
    assert cache.put(work(("cheap", "r", "1", b"a"), ("dear", "r", "1", b"b"), ("dear", "r", "2", None)))
    key = cache.table().where("operation = 'dear'").first().cache_key
    assert bytes(key).hex() == recipe_id("processing-cache", "v1", "dear", "r", "1")
    assert found(("cheap", "r", "1"), ("dear", "r", "1"), ("dear", "r", "2"), ("dear", "q", "1")) == {("cheap", "r", "1"): b"a", ("dear", "r", "1"): b"b"}
    now[0] = 200
    assert cache.put(work(("dear", "r", "1", b"c"))) and found(("dear", "r", "1")) == {("dear", "r", "1"): b"c"}
    assert cache.put(work(*(("dear", "r", str(k), b"x") for k in range(10, 13)), ("cheap", "r", "9", b"y")))
    assert cache.table().count() == 3 and {x.operation for x in cache.table().collect()} == {"dear"}  # six rows are over five
    other = cache.table().withColumn("input_hash", F.lit("forged"))
    made = cache.space.building()
    made.change("cache", cache.table().select("cache_key"), other, ["cache_key"])
    made.publish({})
    assert found(("dear", "r", "10"), ("dear", "r", "11"), ("dear", "r", "12"), ("dear", "r", "1")) == {}
    with cache.space.writing("another"):
        assert not cache.put(work(("dear", "r", "1", b"d")))


def test_plans_read_documents_once(spark):
    from seekwell.operators import context, results

    docs = spark.createDataFrame([("p", f"d/{i}.md", f"{i:064x}", "ready") for i in range(40)], "project_name string, path string, content_hash string, extraction_status string")
    found = results.resolved(docs, ["@000000", "p/d/1.md", "p/d/*.md", "doc://p/d/2.md"], {"p": "/files"})
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2  # the documents and the targets
    assert found.where("at = 3").first().path == "d/2.md" and found.where("at = 2").count() == 40
    contexts = spark.createDataFrame([(f"q{k}", "/", "t", k) for k in range(30)] + [("p", "/", "own", 1), (None, "/d", "all", 2)], "project string, path string, text string, position int")
    whole = context.effective_context(docs, contexts)
    assert {r.context for r in whole.collect()} == {"all\n\nown"}
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "project_name" in next(line for line in plan.splitlines() if "Join Inner" in line or "Join LeftSemi" in line)


def test_counts_follow_random_changes(spark):
    r = random.Random(4)
    schema = "project_name string, path string, extraction_status string, source_size_bytes long"
    table = lambda rows: spark.createDataFrame([(*k, *v) for k, v in rows.items()], schema)
    some = lambda: (r.choice(["ready", "pending", "failed"]), r.choice([None, 3, 10**12]))
    state = {(r.choice("pq"), f"d{i}"): some() for i in range(30)}
    counts = statistics.document_counts(table(state))
    for _ in range(3):
        gone = {k: state[k] for k in r.sample(sorted(state), 12)}
        new = {(r.choice("qr"), f"n{r.randrange(10**6)}"): some() for _ in range(5)} | {k: some() for k in list(gone)[:4]}
        counts = statistics.changed_counts(counts, table(gone), table(new))
        state = {k: v for k, v in state.items() if k not in gone} | new
        assert rows_of(counts) == rows_of(statistics.document_counts(table(state)))
    assert statistics.changed_counts(counts, table(state), table({})).count() == 0
