"""A search by stems reads the plain postings of its terms."""

import os

from seekwell.functions.grammar import parse
from seekwell.jobs import indexing
from seekwell.operators import lexical


def test_postings_are_not_written_again_by_stem(spark, tmp_path, monkeypatch):
    rows = [(i, f"running dog number {i}" if i % 3 else "runs with dogs", "en", "s") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    index = indexing.keyword_index(spark, str(tmp_path), stemmed=True)
    plain = indexing.keyword_index(spark, str(tmp_path))
    assert index.postings.inputFiles() == plain.postings.inputFiles()
    assert all("stems-" in f for f in index.stems.inputFiles()) and index.stems.count() == plain.postings.select("term").distinct().count()
    assert not any(os.path.exists(f"{f.split('file://')[-1].rsplit('/', 1)[0]}/postings") for f in index.stems.inputFiles())
    hits = lambda: sorted(r.path for r in lexical.bm25_topk(index, parse("running dogs"), None).collect())
    found = hits()
    assert len(found) == 60
    monkeypatch.setattr(lexical, "FEW", 0)
    assert hits() == found
