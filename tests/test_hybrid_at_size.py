"""Steps of a search that must not go over, or hold, what they don't need."""

from pyspark.sql import functions as F

from seekwell.jobs import indexing
from seekwell.jobs.queries import _chunk_rows
from seekwell.operators import hybrid


def test_only_documents_with_hits_are_cut_into_chunks(spark):
    docs = spark.createDataFrame([(f"h{i}", f"first line {i}\nsecond word {i}") for i in range(50)], "content_hash string, body string")
    ranked = spark.createDataFrame([("a", "h3", None, 1), ("b", "h7", 1, 2), ("c", "h9", None, 50)], "virtual_path string, content_hash string, chunk_index int, fusion_rank int")
    asked = []

    def cut(some):
        asked.extend(r.content_hash for r in some.collect())
        return _chunk_rows(docs.join(some, "content_hash", "left_semi"))

    found = hybrid.with_evidence(ranked, cut, hybrid.Request(query="word"))
    assert sorted((r.virtual_path, r.evidence, r.evidence_start) for r in found.collect()) == [("a", "second word 3", 13), ("b", "second word 7", 13), ("c", None, None)]
    assert sorted(asked) == ["h3", "h7"]
    whole = hybrid.with_evidence(ranked, _chunk_rows(docs), hybrid.Request(query="word"))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, found.collect()))


def test_a_task_sorts_a_million_tokens_of_an_index(spark):
    lengths = spark.range(1000).select(F.lit(100_000).alias("doc_len"))
    assert indexing._ranges(lengths) >= 100
