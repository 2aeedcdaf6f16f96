"""Text functions, the query language, ranking, chunking and the index's upkeep."""

import hashlib
import os
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from seekwell.functions import grammar, names, stemming, text
from seekwell.functions.names import EngineError
from seekwell.jobs import config
from seekwell.operators import chunking, context, documents, embedding, extraction, fusion, hybrid, lexical, maintenance, results, vector
from seekwell.sources import files
from seekwell.sources.snapshots import Workspace

TOKENS = {
    "Ｆｕｌｌ１２３ IValue can't-stop": "full 123 i value can t stop",
    "src/api.HTTPServer2FA token_bucket rate-limit v2Endpoint": "src api http server 2 fa token bucket rate limit v 2 endpoint",
    "中文测试": "中 文 测 试 中文 文测 测试 中文测 文测试",
    "サーバー": "サ ー バ ー サー ーバ バー サーバ ーバー",
    "Hello中文-world": "hello 中 文 中文 world",
    "中⃝文": "中⃝ 文 中⃝文",
}


def test_tokens(spark):
    rows = spark.createDataFrame([(k,) for k in [*TOKENS, None, ""]], "raw string")
    got = {r.raw: r.t for r in rows.select("raw", text.projection(text.nfkc(rows.raw)).alias("t")).collect()}
    assert got == TOKENS | {None: None, "": ""}
    assert {k: " ".join(grammar.word_tokens(k)) for k in TOKENS} == TOKENS


@pytest.mark.parametrize("query", ["", "  ", "foo - bar", 'foo "unterminated', 'foo ""', '"foo"bar', 'foo"bar"', "foo --bar", "-foo", "!!"])
def test_queries_refused(query):
    with pytest.raises(EngineError):
        grammar.parse(query)


def test_query_clauses():
    got = grammar.parse('rate-limit "token bucket" -redis -"memory cache"')
    assert [(c.text, c.phrase, c.excluded) for c in got] == [
        ("rate-limit", False, False), ("token bucket", True, False), ("redis", False, True), ("memory cache", True, True),
    ]
    assert grammar.atoms(got[0]) == [grammar.Atom(("rate", "limit"), True)]
    assert grammar.atoms(got[1]) == [grammar.Atom(("token", "bucket"), False)]
    assert grammar.plain_terms("a-b -c \"D e\"") == ["a", "b", "d", "e"]


DOCS = [
    ("docs", "alpha.md", "# Alpha deployment\nThe rate limiter uses redis."),
    ("docs", "beta.md", "# Beta deployment\nThe rate limiter has a memory cache."),
    ("docs", "gamma.md", "# Gamma deployment\nA rate limiter, nothing else."),
    ("archive", "old.md", "# Old deployment\nrate and limiter apart."),
]


def index(spark):
    docs = spark.createDataFrame(DOCS, "project_name string, path string, body string")
    docs = docs.withColumn("title", text.title(docs.body, docs.path)).withColumn("content_hash", F.sha2("body", 256))
    return lexical.inverted(lexical.token_index(docs))


@pytest.mark.parametrize(
    "query, scope, paths",
    [
        ("deployment", ["docs"], {"alpha.md", "beta.md", "gamma.md"}),
        ("deployment", ["archive"], {"old.md"}),
        ("deplo", ["docs"], {"alpha.md", "beta.md", "gamma.md"}),
        ('"rate limiter"', None, {"alpha.md", "beta.md", "gamma.md"}),
        ('"rate limiter" -redis', None, {"beta.md", "gamma.md"}),
        ('"rate limiter" -"memory cache"', None, {"alpha.md", "gamma.md"}),
    ],
)
def test_keyword_search(spark, query, scope, paths):
    hits = lexical.bm25_topk(index(spark), grammar.parse(query), 10, scope).collect()
    assert {h.path for h in hits} == paths
    assert all(h.raw_bm25 < 0 and 0 < h.score < 1 for h in hits)
    assert [h.raw_bm25 for h in hits] == sorted(h.raw_bm25 for h in hits)


SCRIPTS = [("p", "a", "rate\nlimiter ｆｕｌｌ width"), ("p", "b", "word 中文测 x 文测试"), ("p", "c", "word 中文测试"), ("p", "d", None), ("p", "e", "running dogs, naïve")]


@pytest.mark.parametrize(
    "query, paths",
    [('"rate limiter"', "a"), ('"full width"', "a"), ('word -"中文测试"', "b"), ('"中文测试"', "c"), ("中文", "bc"), ('-"中文测试" word', "b")],
)
def test_phrases_and_scripts(spark, query, paths):
    docs = spark.createDataFrame(SCRIPTS, "project_name string, path string, body string").withColumn("title", text.title(F.lit(""), F.lit("t")))
    found = lexical.bm25_topk(lexical.inverted(lexical.token_index(docs)), grammar.parse(query), None, bodies=docs).collect()
    assert "".join(sorted(r.path for r in found)) == paths


def test_stems_find_other_forms(spark):
    docs = spark.createDataFrame(SCRIPTS, "project_name string, path string, body string").withColumn("title", F.lit("t"))
    stems = lexical.with_stems(lexical.inverted(lexical.token_index(docs)))
    for query in ("runs dog", '"running dog"', "naive", "dog naïve"):
        assert [r.path for r in lexical.bm25_topk(stems, grammar.parse(query), None).collect()] == ["e"], query


def test_quick_tokens_are_those_of_the_slow_way(spark):
    r = random.Random(3)
    signs = list("abAB12zZ ._-'\"́̈ßÉéÑ中文サーがσΣςǅ٣ªʰ９ｆ")
    rows = [("".join(r.choice(signs) for _ in range(r.randint(0, 14))),) for _ in range(3000)]
    got = spark.createDataFrame(rows, "t string").select("t", text.tokens(text.nfkc(F.col("t"))).alias("n")).collect()
    assert [(g.t, g.n) for g in got if g.n != grammar.word_tokens(g.t)] == []


def test_characters_taken_for_stable_and_for_other_scripts(spark):
    every = spark.createDataFrame([(chr(c),) for c in range(0x80, 0x2FA20) if not 0xD800 <= c < 0xE000], "c string")
    stable = [r.c for r in every.where(~F.col("c").rlike(f"[^{text._STABLE}]")).collect()]
    second = {x for c in range(0x80, 0x2FA20) if not 0xD800 <= c < 0xE000 for x in unicodedata.normalize("NFD", chr(c))[1:]}
    assert len(stable) > 1000 and all(unicodedata.normalize("NFKC", c) == c and c not in second for c in stable)
    assert every.where(F.col("c").rlike(f"[{text._CJK}]") & ~F.col("c").rlike(text._MAYBE_CJK)).count() == 0


def test_postings_agree_with_counts(spark):
    rows = index(spark).postings.where(lexical.prefix_range("limit")).collect()
    assert {(r.path, r.col, r.tf) for r in rows} == {(p, 1, 1) for p in ("alpha.md", "beta.md", "gamma.md", "old.md")}


def test_vector_limit_counts_documents(spark):
    rows = [("p", "long.md", i, [1.0, 0.0]) for i in range(3)] + [("p", "short.md", 0, [0.0, 0.0]), ("q", "other.md", 0, [float("nan"), 0.0])]
    vecs = spark.createDataFrame(rows, "project_name string, path string, chunk_index int, embedding array<float>")
    query = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query array<float>")
    got = vector.nearest_documents(vecs, query, 2).orderBy("project_name", "rank").collect()
    assert [(r.path, r.chunk_index, r.distance) for r in got[:2]] == [("long.md", 0, 0.0), ("short.md", 0, 1.0)]
    assert got[2].distance == vector.FARTHEST
    assert vector.nearest_documents(vecs, query, None).count() == 3
    ok = [r.ok for r in vecs.select(vector.valid("embedding", 2).alias("ok")).collect()]
    assert ok == [True] * 4 + [False]


def test_fusion_and_blend(spark):
    rows = [("a", 2.0, 1, "x"), ("a", 2.0, 2, "y"), ("b", 1.0, 1, "y"), ("b", 1.0, 4, "z")]
    got = fusion.fused(spark.createDataFrame(rows, "query_id string, weight double, rank int, virtual_path string"))
    scores = {r.virtual_path: r.fusion_score for r in got.collect()}
    assert scores == pytest.approx({"x": 2 / 61 + 0.05, "y": 2 / 62 + 1 / 61 + 0.05, "z": 1 / 64})
    many = [(f"p{i:02}", i, 1.0 / i, 1.0 if i == 40 else 0.0) for i in range(1, 46)]
    out = fusion.blended(spark.createDataFrame(many, "virtual_path string, fusion_rank int, fusion_score double, rerank double"))
    ordered = [r.virtual_path for r in out.orderBy("final_rank").collect()]
    assert ordered[:2] == ["p01", "p40"] and ordered[40:] == ["p41", "p42", "p43", "p44", "p45"]


def test_effective_context(spark):
    rows = [(None, "/", "global root"), (None, "/api", "global api"), ("docs", "/", "docs root"), ("docs", "/api", "docs api"),
            ("docs", "/api/internal", "docs internal"), ("notes", "/", "notes")]
    ctx = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "project string, path string, text string, position int")
    docs = spark.createDataFrame([("docs", "api/internal/guide.md"), ("docs", "apix/guide.md"), ("none", "a")], "project_name string, path string")
    got = {r.path: r.context.split("\n\n") for r in context.effective_context(docs, ctx).collect()}
    assert got == {
        "api/internal/guide.md": ["global root", "global api", "docs root", "docs api", "docs internal"],
        "apix/guide.md": ["global root", "docs root"],
        "a": ["global root"],
    }


def test_chunks_are_bounded_and_cover():
    fenced = "# t\n```\n" + "x" * 100 + "\n```\nend\n"
    spans = chunking.chunks(fenced, len, 168)
    assert len(spans) > 1 and all(b - a <= 40 for a, b in spans) and spans[-1][1] == len(fenced)
    r = random.Random(1)
    for _ in range(50):
        body = "".join(r.choice(["word ", "\n", "\n\n", "# head\n", "```\n", "longword" * 5]) for _ in range(r.randint(1, 200)))
        spans = chunking.chunks(body, len, 168)
        if body.strip():
            assert spans[0][0] == 0 and spans[-1][1] == len(body)
            assert all(c <= b and c > a for (a, b), (c, _) in zip(spans, spans[1:], strict=False))
            assert all(b - a <= 40 for a, b in spans)
    assert chunking.chunks(" \n") == []


def restated_chunks(body, limit):
    """The chunk rules again, a step at a time; tokens are characters."""
    lines = [(m.start(), m.end(), m[0].rstrip("\n").removesuffix("\r")) for m in re.finditer(r"[^\n]*\n|[^\n]+$", body)]
    edges, fences, inside = [], [], None
    for a, b, line in lines:
        if re.match(r" ? ? ?```", line):
            edges.append((a if inside is None else b, 2))
            if inside is not None:
                fences.append((inside, b))
            inside = a if inside is None else None
        elif inside is None:
            if re.match(r" ? ? ?#{1,6}(\s|$)", line):
                edges.append((a, 3))
            edges.append((b, 0 if line.strip() else 1))
    if inside is not None:
        fences.append((inside, len(body)))
    out, start, done = [], 0, 0
    while done < len(body):
        end = min(len(body), start + min(3 * limit, limit))
        cut = [f for f in fences if f[0] < end < f[1]][:1]
        hard = False
        if cut and cut[0][0] > start:
            end, hard = cut[0][0], True
        elif cut and cut[0][1] - start <= limit:
            end, hard = cut[0][1], True
        if not hard and end < len(body):
            fit = [(p, o) for o, p in edges if max(done + 1, start + (end - start) // 2) <= o <= end]
            if fit:
                p, end = max(fit)
                hard = p > 0
        out.append((start, end))
        done = end
        if hard:
            start = done
            continue
        back = end - max(1, (end - out[-1][0]) // 10)
        while back < end and end - back > max(1, min(96, limit // 10)):
            back += max(1, (end - back) // 3)
        line = body.find("\n", back)
        if line >= 0 and line + 1 < end:
            back = line + 1
        start = end if back <= out[-1][0] or back >= end else back
    return out


def test_chunks_follow_the_rules_on_markdown():
    r, count = random.Random(2), 0
    parts = ["word ", "longer words here ", "\n", "\n\n", "# head\n", "   ### deep\n", "```\n", "  ````py\n", "x\x0cy ", "\r\n", " \n", "tail\u2028more "]
    for _ in range(2000):
        body = "".join(r.choice(parts) for _ in range(r.randint(1, 150)))
        if body.strip():
            count += 1
            assert chunking.chunks(body, len, 168) == restated_chunks(body, 40), repr(body)
    assert count > 1900


def test_stems():
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop",
            "filing": "file", "happy": "happi", "relational": "relat", "formalize": "formal", "adoption": "adopt", "probate": "probat", "controll": "control"}
    assert {w: stemming.porter(w) for w in want} == want


def test_names():
    assert names.canonical_project(" My docs!! (v2)_") == "My-docs-v2"
    assert names.parse_virtual_path("doc://a/b/c.md") == ("a", "b/c.md")
    assert [names.valid_path(p) for p in ("a/b", "/a", "a//b", "a/..", "", "a/")] == [True, False, False, False, False, False]
    assert names.recipe_id("ab", "c") != names.recipe_id("a", "bc")
    assert names.parse_size("64KiB") == 65536 and names.score_text(0.5) == "0.5" and names.csv_cell('a"b') == '"a""b"'
    with pytest.raises(EngineError):
        names.parse_size("0MB")


def test_globs_and_prefixes(spark):
    docs = spark.createDataFrame([("a.md",), ("x/a.md",), ("x/y/b.txt",), ("x%/c.md",)], "path string")
    assert {r.path for r in documents.by_glob(docs, "**/*.md").collect()} == {"a.md", "x/a.md", "x%/c.md"}
    assert {r.path for r in documents.by_glob(docs, "*.md").collect()} == {"a.md"}
    assert {r.path for r in documents.by_prefix(docs, "x").collect()} == {"x/a.md", "x/y/b.txt"}


def test_eviction_keeps_what_it_says(spark):
    rows = [(bytes([i]), "cheap" if i % 3 else "dear", i // 10) for i in range(100)]
    cache = spark.createDataFrame(rows, "cache_key binary, operation string, created_at long")
    gone = maintenance.evicted(cache, 90, 55, ["cheap"]).collect()
    order = sorted(rows, key=lambda r: (r[1] != "cheap", r[2], r[0]))
    assert sorted(bytes(r.cache_key) for r in gone) == sorted(r[0] for r in order[:45])
    assert maintenance.evicted(cache, 100, 55, ["cheap"]).count() == 0


def test_file_kinds():
    iso = lambda brand: b"\0\0\0\x18ftyp" + brand
    kinds = {
        b"": "text", b"plain": "text", b"%PDF-1.7": "pdf", b"\x89PNG\r\n\x1a\n": "image", b"BM6": "image", b"II*\0": "image", b"MM\0*": "image",
        b"RIFF....WEBP": "image", iso(b"heic"): "image", iso(b"avif"): "image", iso(b"mif1"): "image", iso(b"M4A "): "video", iso(b"isom"): "video",
        b"RIFF....AVI ": "video", b"\x1aE\xdf\xa3": "video", b"\0\0\x01\xba": "video", b"OggS\0\x80theora": "video", b"OggS\0vorbis": "audio",
        b"ID3": "audio", b"fLaC": "audio", b"RIFF....WAVE": "audio", b"\xff\xfb\x90": "audio", b"\xff\xfe\x00x": "audio", b"\x01\x02\x03ab": "other",
        "é".encode(): "text", "a\x85b".encode(): "other", b"\xc3(": "other",
    }
    assert {h: files.kind_of(h, True) for h in kinds} == kinds
    assert files.kind_of(("a" * 8191 + "é").encode()[:8192], False) == "text"


def test_ignore_rules():
    frames = [("", files.ignore_rules("*.log\nbuild/\n!keep.log\n/top.txt\na/**/z\n#no\n\\#yes\n[ab].md \n")), ("sub", files.ignore_rules("!*.log\n"))]
    hidden = {"a.log": 1, "keep.log": 0, "sub/b.log": 0, "x/c.log": 1, "top.txt": 1, "x/top.txt": 0, "a/z": 1, "a/q/r/z": 1, "#yes": 1, "#no": 0, "x/a.md": 1, "c.md": 0}
    assert {p: int(files.ignored(frames[: 1 + p.startswith("sub")], p, False)) for p in hidden} == hidden
    assert files.ignored(frames, "sub/build", True) and not files.ignored(frames, "build", False)


def test_listing_follows_ignore_files_links_and_globs(spark, tmp_path):
    def put(path, body="x"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)

    for p in ("a.md", "_b.md", ".c.md", "deep/er/and/d.md", "deep/er/skip/e.md", "deep/er/f.log", "node_modules/g.md", "no.txt", "out/h.md"):
        put(p)
    put("deep/er/.gitignore", "skip/\n*.log\n")
    (tmp_path / "link.md").symlink_to(tmp_path / "no.txt")
    (tmp_path / "folder").symlink_to(tmp_path / "deep")
    rows = files.listed(spark, str(tmp_path), ("**/*.md", "**/*.log"), ("out/*",)).collect()
    assert {r.path for r in rows} == {"a.md", "_b.md", ".c.md", "deep/er/and/d.md", "link.md"}
    assert all(r.source_mtime_ns == os.stat(tmp_path / r.path).st_mtime_ns and r.source_size_bytes == 1 for r in rows)
    assert {r.path for r in files.listed(spark, str(tmp_path), use_ignore=False).collect()} > {"deep/er/f.log", "deep/er/skip/e.md", "out/h.md"}


def test_configuration(spark, tmp_path):
    path = str(tmp_path / "c.yml")
    assert config.load(path) == config.Config()
    with open(path, "w") as f:
        f.write('{"projects": [{"name": "a", "root": "x", "include": ["**/*.md"]}, {"name": "b", "root": "/y", "default-search": false}],'
                ' "context": [{"path": "/", "text": "one"}, {"project": "a", "path": "/", "text": "two"}, {"path": "/", "text": "three"}]}')  # fmt: skip
    c = config.load(path)
    assert c.projects[0].root == str(tmp_path / "x") and [x.text for x in c.contexts] == ["three", "two"]
    assert c.default_scope() == ["a"] and c.scope(["b", "a", "b"]) == ["b", "a"] and c.locate("/y/z.md") == ("b", "z.md") and c.locate("/q") is None
    with pytest.raises(EngineError, match="no project"):
        c.scope(["q"])
    d = c.renamed("a", "c d").with_default_search(["b"], True).with_context(config.Context("b", "/k", "four"))
    assert d.default_scope() == ["c-d", "b"] and [x.project for x in d.contexts] == [None, "c-d", "b"]
    assert [x.project for x in d.without_project("b").without_context("c-d", "/").contexts] == [None]
    config.save(d, path)
    assert config.load(path) == d and d.context_rows(spark).count() == 3 and d.project_rows(spark).count() == 2
    with open(path, "w") as f:
        f.write("{nothing")
    with pytest.raises(EngineError):
        config.load(path)
    assert config.load_for_change(path) == config.Config() and len(os.listdir(tmp_path)) == 1


def test_requests_and_candidates():
    request = hybrid.Request(query="rate limiter", intent="speed")
    got = hybrid.candidates(request, lambda text: hybrid.Expansion(("Rate Limiter", "bad --query", "x"), ("how fast",), ("a passage",)))
    assert [(c.kind, c.weight, c.text) for c in got] == [
        ("query", 2.0, "rate limiter"), ("lex", 1.0, "bad --query"), ("lex", 1.0, "x"),
        ("query", 2.0, "rate limiter\nQuery intent: speed"), ("vec", 1.0, "how fast"), ("hyde", 1.0, "a passage"),
    ]
    own = hybrid.candidates(hybrid.Request(vec="near", intent="speed"))
    assert [(c.kind, c.text) for c in own] == [("vec", "near\nQuery intent: speed")]
    with pytest.raises(EngineError, match="expansion"):
        hybrid.candidates(request, lambda text: hybrid.Expansion(("x",), ("y",)))
    for bad, mode in ((hybrid.Request(), "hybrid"), (hybrid.Request(vec="x"), "lexical"), (hybrid.Request(query="x", limit=0), "vector"),
                      (hybrid.Request(query="x", paths=True, full=True), "hybrid"), (hybrid.Request(query='"x'), "lexical")):
        with pytest.raises(EngineError):
            hybrid.validate(bad, mode)
    assert hybrid.candidate_limit(5) == 40 and hybrid.candidate_limit(None) is None and hybrid.rerank_query(request) == "speed\n\nrate limiter"


def test_results(spark):
    body = "first\nsecond has rate\nthird\nfourth"
    rows = [(1, "a" * 64, "doc://p/x", "X", 0.5, body, "third\nfourth", 23, "about p"), (2, "b" * 64, "doc://p/y", "Y", 0.25, body, None, None, "")]
    schema = "final_rank int, content_hash string, virtual_path string, title string, score double, body string, evidence string, evidence_start int, context string"
    matches = spark.createDataFrame(rows, schema)
    got = results.items(matches, hybrid.Request(query="rate fourth", line_numbers=True)).orderBy("final_rank").collect()
    assert [(r.snippet, r.line) for r in got] == [("3: third\n4: fourth", 4), ("1: first\n2: second has rate\n3: third", 2)]
    full = results.items(matches, hybrid.Request(query="rate", full=True)).orderBy("final_rank").collect()
    assert [(r.snippet, r.body, r.line) for r in full] == [("", body, 3), ("", body, 2)]
    paths = results.items(matches, hybrid.Request(query="rate", paths=True)).orderBy("final_rank").collect()
    assert [(r.id, r.snippet, r.body) for r in paths] == [("@aaaaaa", "", None), ("@bbbbbb", "", None)]
    assert results.rendered(paths, "paths") == "doc://p/x\ndoc://p/y" and "0.25" in results.rendered(full, "csv") and "## X" in results.rendered(full, "md")


def test_lookup(spark):
    h = ["a" * 64, "a" * 64, "c" * 64, None]
    rows = [("p", "x.md", h[0], "ready", "one\ntwo\n"), ("p", "y.md", h[1], "ready", "one"), ("q", "z.md", h[2], "ready", "long" * 50), ("q", "w.pdf", None, "pending", None)]
    docs = spark.createDataFrame(rows, "project_name string, path string, content_hash string, extraction_status string, body string")
    targets = ["@AAAAAA", "@cccccc", "doc://p/x.md", "p/*.md", "/files/q/w.pdf", "p/none.md"]
    found = results.resolved(docs, targets, {"p": "/files/p", "q": "/files/q"})
    got = [(r.target, r.virtual_path, r.state, r.body) for r in results.got(docs, found, 100, 1, 1).collect()]
    assert got == [
        ("@AAAAAA", "doc://p/x.md", "ambiguous", None), ("@AAAAAA", "doc://p/y.md", "ambiguous", None), ("@cccccc", "doc://q/z.md", "skipped", None),
        ("doc://p/x.md", "doc://p/x.md", "ok", "one\n"), ("p/*.md", "doc://p/x.md", "ok", "one\n"), ("p/*.md", "doc://p/y.md", "ok", "one\n"),
        ("/files/q/w.pdf", "doc://q/w.pdf", "not_ready", None), ("p/none.md", None, "missing", None),
    ]
    assert results.exit_code(["ok", "skipped"]) == 0 and results.exit_code(["ok", "missing"]) == 3 and results.exit_code(["missing"]) == 1


def test_cleaned_text():
    clean = extraction.cleaned_text
    assert clean("abcd efgh", "abcd efgh", "Sure: ```text\nabcd efgh!\n```") == "abcd efgh!"
    assert clean("abcd efgh", "abcd efgh", "a") == "abcd efgh" and clean("ab", "ab", "x" * 300) == "ab" and clean("abcd rest", "abcd", "ABCD") == "ABCD rest"
    assert clean("x", "x", None) == "x"


def test_embedding_batches_fail_alone(spark):
    rows = [(i, "p", "h", 0, f"text {i}") for i in range(64)]
    work = spark.createDataFrame(rows, "document_id long, project_name string, content_hash string, chunk_index int, input string").coalesce(1)

    def embed(texts):
        if "text 40" in texts:
            raise RuntimeError("no")
        return embedding.hashed_embedding(8)(texts)

    found = embedding.embedded(work, embed, 8)
    assert embedding.report(found).first() == (32, 32, 32)
    assert {r.failure for r in found.collect()} == {None, "no"}


def assert_searches(space):
    """Searches of the synced workspace, by keywords, vectors and both."""
    from seekwell.jobs.searching import SearchModels, search

    places = config.Config((config.Project("p", "/p"), config.Project("q", "/q", default_search=False)), (config.Context("p", "/", "about p"),))
    models = SearchModels(embedding.hashed_embedding(8), lambda text: hybrid.Expansion(("longer",), ("near",), ("a passage",)))
    found = search(space, places, hybrid.Request(query="body"), "lexical", models).collect()
    assert [(r.virtual_path, r.snippet, r.line, r.context) for r in found] == [("doc://p/a.md", "# One\nbody, longer", 2, "about p")]
    steps = []
    search(space, places, hybrid.Request(query="body"), "hybrid", models, traces=steps)
    told = [(r.step, r.rank, r.virtual_path) for r in steps[0].collect()]
    assert ("ranking 0", 1, "doc://p/a.md") in told and ("fusion", 1, "doc://p/a.md") in told
    near = search(space, places, hybrid.Request(query="three", limit=2), "vector", models).collect()
    assert [r.final_rank for r in near] == [1, 2] and all(r.id.startswith("@") for r in near)
    both = search(space, places, hybrid.Request(query="body longer", paths=True, limit=3), "hybrid", models).collect()
    assert both[0].virtual_path == "doc://p/a.md" and len(both) == 3 and both[0].snippet == ""
    with pytest.raises(EngineError, match="no vectors"):
        search(space, places, hybrid.Request(query="x"), "vector", models, ["q"])
    with pytest.raises(EngineError, match="no project"):
        search(space, places, hybrid.Request(query="x"), "lexical", models, ["none"])
    assert search(space, places, hybrid.Request(query="body"), "lexical", models, ["q"]).collect() == []


def test_sync_is_incremental_and_equals_a_rebuild(spark, tmp_path):
    from seekwell.jobs.sync import Models, sync
    from seekwell.streaming.resync import resync

    root = tmp_path / "docs"
    (root / "node_modules").mkdir(parents=True)
    for name, body in (("a.md", "# One\nbody"), ("b.md", "two"), ("copy.md", "two"), ("node_modules/x.md", "no")):
        (root / name).write_text(body)
    (root / "raw.bin").write_bytes(b"\x00\x01\x02\x03")
    (root / "p.pdf").write_bytes(b"%PDF-one")
    (root / "q.pdf").write_bytes(b"%PDF-bad")

    def extract(path, kind):
        raw = open(path, "rb").read()
        if b"bad" in raw:
            raise ValueError("no text in it")
        return f"text of a {kind}", hashlib.sha256(raw).hexdigest()

    models = Models(extract=extract, extract_recipes=(("pdf", "r1"),), embed=embedding.hashed_embedding(8), embed_recipe="e1", dims=8)
    space = Workspace(spark, str(tmp_path / "w"))
    assert space.status() == "missing"
    assert sync(space, {"p": str(root)}, models) == {"added": 6, "embedded": 4, "embedding_failed": 0}
    state = {r.path: (r.extraction_status, r.file_type) for r in space.read("documents").collect()}
    assert space.status() == "ready" and state["p.pdf"] == ("ready", "pdf") and state["q.pdf"] == ("failed", "pdf") and state["raw.bin"] == ("failed", "other")
    (root / "b.md").unlink()
    (root / "new.md").write_text("three")
    (root / "a.md").write_text("# One\nbody, longer")
    os.utime(root / "p.pdf", ns=(5, 5))
    assert sync(space, {"p": str(root)}, models) == {"added": 1, "changed": 2, "removed": 1, "unchanged": 3, "embedded": 2, "embedding_failed": 0}
    fresh = Workspace(spark, str(tmp_path / "fresh"))
    sync(fresh, {"p": str(root)}, models)
    for table in ("documents", "contents", "chunks", "lexical", "embeddings"):
        rows = [sorted(map(repr, w.read(table).drop("updated_at").collect())) for w in (space, fresh)]
        assert rows[0] == rows[1] and rows[0], table
    assert_searches(space)
    # another recipe makes its results anew
    other = Models(extract=lambda p, k: ("else", extract(p, k)[1]), extract_recipes=(("pdf", "r2"),), embed=models.embed, embed_recipe="e2", dims=8)
    assert sync(space, {"p": str(root)}, other)["embedded"] == 4
    assert "else" in {r.body for r in space.read("contents").collect()}
    with space.writing("test"), pytest.raises(EngineError):
        sync(space, {"p": str(root)})
    (root / "late.md").write_text("four")
    resync(space, {"p": str(root)}, str(tmp_path / "c")).awaitTermination(120)
    assert "late.md" in {r.path for r in space.read("documents").collect()}
    assert sync(space, config.Config()) == {"removed": 7} and space.read("contents").count() == 0
    assert not os.path.exists(f"{space.path}/LOCK")
