"""Blocks made of tokens without postings, and the quick test of texts that may change."""

import random
import re
import unicodedata

from seekwell.functions import text
from seekwell.functions.grammar import parse
from seekwell.jobs import indexing
from seekwell.operators import impacts, lexical

ROW = "project_name string, path string, body string"


def test_blocks_of_tokens_are_those_of_postings(spark, tmp_path, monkeypatch):
    r = random.Random(6)
    words = ["the", "then", "of", "and", "rare", "Über", "x2y"]
    rows = [(r.choice("aab"), f"d{i}", " ".join(r.choices(words, k=int(r.paretovariate(0.9) * 5) % 300))) for i in range(900)]
    rows += [("c", "empty", ""), ("c", "one", "the")]
    monkeypatch.setattr(impacts, "STEP", 2000)
    tokens = indexing.tokenized(spark.createDataFrame(rows, ROW)).drop("body")
    made = impacts.made_of(tokens)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Join" not in plan
    indexing.write_impacts_of_tokens(tokens, f"{tmp_path}/t")
    own = indexing.read_impacts(spark, f"{tmp_path}/t")
    plain = lexical.inverted(tokens)
    assert sorted((d.project_name, d.path) for b in own.blocks.collect() for d in b.docs) == sorted((p, q) for p, q, _ in rows)
    for query, limit, scope in (("the", 20, None), ("of th -rare", 50, ["a", "b"]), ("über x", 2000, None), ("d1 the", 20, None)):
        hits = lambda df: [(h[0], h[1], round(h[2], 9), round(h[3], 9)) for h in df.collect()]
        assert hits(impacts.topk(own, parse(query), limit, scope)) == hits(lexical.bm25_topk(plain, parse(query), limit, scope))
    # the counts of a term are those of the blocks made of postings
    places = impacts.placed(plain.lengths).cache()
    other = impacts.impacts_of(plain.postings, places)
    sums = lambda df: sorted(map(tuple, df.selectExpr("whole", "term", "aggregate(counts, 0, (a, b) -> a + b) AS n").groupBy("whole", "term").sum("n").collect()))
    assert sums(own.impacts) == sums(other)


def test_no_documents(spark, tmp_path):
    tokens = indexing.tokenized(spark.createDataFrame([], ROW)).drop("body")
    indexing.write_impacts_of_tokens(tokens, f"{tmp_path}/t")
    assert impacts.topk(indexing.read_impacts(spark, f"{tmp_path}/t"), parse("the"), 5).collect() == []


def test_what_may_change_is_beyond_the_quick_tests():
    quick = re.compile(f"{text._BEYOND_STABLE}|{text._LATIN_CHANGING}")
    for n in range(0x110000):
        c = chr(n)
        if not quick.search(c):
            assert unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c), hex(n)
