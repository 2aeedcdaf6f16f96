"""Searches of a table that is gone through once, n-grams by run, and postings made within a row."""

import pytest
from pyspark.sql import functions as F

from seekwell.functions import text
from seekwell.functions.grammar import parse
from seekwell.operators import lexical

ROWS = [
    ("p", "a.txt", "a", "国語の本 中国語 Über fooBar x2y ÅNGSTRÖMUnit"),
    ("p", "b.txt", "国語", "日本語日本語 に本中 of the day OF THE"),
    ("q", "c.txt", "c", "plain words of the 3rd HTTPServer of the"),
    ("q", "d.txt", "d", ""),
    ("q", "e.txt", "e", "が語 がー Σίσυφος … ‘quoted’"),
]


def docs(spark):
    return spark.createDataFrame(ROWS, "project_name string, path string, title string, body string")


@pytest.mark.parametrize("query", ['"国語"', '"本" -"日本"', '"of the"', "of-th", "fo ba", "国 本", '"語" "本語"'])
def test_a_table_searched_once_has_the_hits_of_its_index(spark, query):
    clauses, table = parse(query), docs(spark)
    whole = lexical.bm25_topk(lexical.inverted(lexical.token_index(table)), clauses, None, bodies=table).collect()
    once = lexical.answering(table, clauses)
    assert lexical.bm25_topk(once, clauses, None, bodies=table).collect() == whole
    assert whole
    wanted = {t for c in clauses for a in lexical.atoms(c) for t in a.tokens}
    assert all(any(r.term.startswith(t) for t in wanted) for r in once.postings.collect())


def test_tokens_are_counted_without_making_them(spark):
    both = docs(spark).select(text.nfkc(F.col("body")).alias("t")).select(F.size(text.tokens(F.col("t"))).alias("a"), text.token_count(F.col("t")).alias("b"))
    assert all(r.a == r.b for r in both.collect())


def test_postings_are_made_without_a_shuffle(spark):
    plan = lexical.postings(lexical.token_index(docs(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_grams_are_counted_by_run(spark):
    rows = [(1, ["国語国語", "語"]), (1, ["語"]), (2, ["が語"]), (None, ["語"]), (3, []), (4, None)]
    table = spark.createDataFrame(rows, "doc_id long, runs array<string>")
    each = table.select("doc_id", F.explode("runs").alias("run")).select("doc_id", F.explode(text.cjk_grams(F.col("run"))).alias("gram"))
    plain = each.groupBy("gram").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))
    assert sorted(map(tuple, lexical.gram_totals(table).collect())) == sorted(map(tuple, plain.collect()))
