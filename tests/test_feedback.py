"""What the corpus adds to a search, against brute force."""

import math
import random

from seekwell.jobs import config, indexing
from seekwell.jobs.searching import SearchModels, search
from seekwell.jobs.sync import Models, sync
from seekwell.operators import embedding, feedback, hybrid, lexical
from seekwell.sources.snapshots import Workspace

ROW = "project_name string, path string, title string, body string"


def made(spark, rows):
    docs = spark.createDataFrame([("p", f"d{i}", "", b) for i, b in enumerate(rows)], ROW)
    return docs, lexical.inverted(lexical.token_index(docs))


def test_lines_of_a_model():
    got = feedback.parse_expansion(" LEX : rate\t limit \r\nvec: how  fast\nhyde:\nother: x\n: y\nno line\nlex:a:b hyde: A text.")
    assert got == hybrid.Expansion(("rate limit", "a:b"), ("how fast",), ("A text.",))
    assert feedback.parse_expansion("") == feedback.parse_expansion(None) == hybrid.Expansion()


def idf(n, df):
    return max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)


def test_shortest_stretch(spark):
    r = random.Random(3)
    rows = ["", "alpha", "beta x alpha y z beta", *(" ".join(r.choices(["alpha", "beta", "gammas", "x", "y", "z"], [1, 1, 1, 9, 9, 9], k=r.randint(1, 60))) for _ in range(60))]
    docs, index = made(spark, rows)
    words = ["alpha", "beta", "gamma", "none"]
    got = {x["path"]: (x["present"], x["span"], x["closeness"]) for x in feedback.proximity(index, " ".join(words), docs).collect()}
    held = [[{i for i, w in enumerate(words) if t.startswith(w)} for t in b.split()] for b in rows]
    dfs = [sum(any(i in t for t in b) for b in held) for i in range(4)]
    weights = [idf(len(rows), d) for d in dfs]
    assert len(got) == len(rows)
    for no, b in enumerate(held):
        all_of = set().union(*b) if b else set()
        spans = [j - i + 1 for i in range(len(b)) for j in range(i, len(b)) if all_of and set().union(*b[i : j + 1]) == all_of]
        present, span, close = got[f"d{no}"]
        assert present == len(all_of) and span == (min(spans) if spans else None)
        want = sum(weights[i] for i in all_of) / sum(weights) * (1 + present / span) / 2 if all_of else 0.0
        assert abs(close - want) < 1e-8
    assert {x["closeness"] for x in feedback.proximity(index, "?", docs).collect()} == {0.0}


def test_words_of_the_first_hits(spark):
    rows = ["cats chase mice", "cats purr softly mice", "dogs bark", "dogs bark at the moon", "mice eat cheese", "cats7 id42 x"]
    docs, index = made(spark, rows)
    got = [(r["term"], r["docs"]) for r in feedback.expansion_terms(index, docs, "cats").collect()]
    assert got == [("mice", 3)]  # other words of these hits are in no other document
    assert feedback.expansion_terms(index, docs, "zebra").count() == 0
    expand = feedback.from_corpus(index, docs)
    assert expand("cats\nQuery intent: zebra") == hybrid.Expansion(("mice",), ("cats mice",), ("cats chase mice",))
    assert expand("zebra") == expand("?") == hybrid.Expansion()
    assert feedback.from_corpus(index, docs, [])("cats") == hybrid.Expansion()


def test_a_workspace_needs_no_models_for_these(spark, tmp_path):
    (tmp_path / "files").mkdir()
    texts = {"near.md": "A rate limiter guards the gateway.", "far.md": "The rate is high. " + "Filler words here. " * 30 + "A limiter guards the gateway.",
             "other.md": "Nothing of that guards the gateway.", "none.md": "Soup with beans."}
    for name, text in texts.items():
        (tmp_path / "files" / name).write_text(text)
    c = config.Config((config.Project("p", str(tmp_path / "files")),))
    space = Workspace(spark, str(tmp_path / "w"))
    embed = embedding.hashed_embedding(8)
    sync(space, c, Models(embed=embed, embed_recipe="hashed", dims=8))
    traces = []
    got = search(space, c, hybrid.Request(query="rate limiter"), "hybrid", SearchModels(embed), traces=traces).collect()
    paths = [r["virtual_path"] for r in got]
    assert paths.index("doc://p/near.md") < paths.index("doc://p/far.md") and len(traces) == 1
