"""Projects, their files, and formats."""

import pytest
from pyspark.sql import functions as F

from seekwell.functions.formats import size_text, time_text
from seekwell.functions.names import EngineError
from seekwell.jobs import config, projects

PLACES = config.Config((config.Project("a", "/x/a"), config.Project("b", "/x/b", default_search=False)))


def test_formats(spark):
    sizes = {None: "unknown", -1: "unknown", 0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.3 KB", 1024**2 - 1: "1024.0 KB", 3 * 1024**3: "3.0 GB", 2**62: "4096.0 PB"}
    times = {None: "0ms", -5: "0ms", 999: "999ms", 1000: "1.0s", 9949: "9.9s", 10_000: "10s", 59_499: "59s", 59_500: "1m 0s", 303_000: "5m 3s", 7_800_000: "2h 10m"}
    for cases, how in ((sizes, size_text), (times, time_text)):
        rows = spark.createDataFrame([(k,) for k in cases], "v long").select(how(F.col("v")).alias("t"))
        assert [r.t for r in rows.collect()] == list(cases.values())


def test_projects(spark):
    docs = spark.createDataFrame([("a", "k/one"), ("a", "kk"), ("b", "k/two")], "project_name string, path string")
    assert [r.project_name for r in projects.listed(PLACES, spark).collect()] == ["a", "b"]
    assert [r.project_name for r in projects.listed(PLACES, spark, True).collect()] == ["a"]
    counts = docs.groupBy("project_name").agg(F.count("*").alias("documents"), F.lit(2048).cast("long").alias("bytes"))
    got = projects.shown(PLACES, counts.where("project_name = 'a'"), "a").first()
    assert (got.root, got.documents, got["size"]) == ("/x/a", 2, "2.0 KB")
    got = projects.shown(PLACES, counts.where("project_name = 'a'"), "b").first()
    assert (got.documents, got["size"]) == (0, "0 B")
    paths = lambda text: sorted(r.path for r in projects.files(PLACES, docs, text).collect())
    assert paths("a") == paths("doc://a") == paths("/x/a") == ["k/one", "kk"]
    assert paths("a/k") == paths("doc://a/k") == paths("/x/a/k") == ["k/one"] and paths("b/none") == []
    for bad in ("doc://c/k", "/y", "", " "):
        with pytest.raises(EngineError):
            projects.files(PLACES, docs, bad)
