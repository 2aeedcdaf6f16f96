"""Making the keyword index of a table of documents, once for many searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekwell.functions.grammar import Clause
from seekwell.functions.text import title
from seekwell.operators import lexical
from seekwell.operators.impacts import Impacts, blocks_of, impacts_of, made_of, placed
from seekwell.operators.lexical import KEY, Index, inverted, token_index, with_stems
from seekwell.schemas import documents
from seekwell.sources import store
from seekwell.sources.shared import fresh_path, shared_dir, spread, written

_MADE: dict[tuple, str] = {}


def write_index(index: Index, path: str) -> None:
    """Postings in ranges of terms; a term of very many documents goes over several files."""
    order = ["term", *KEY]
    index.lengths.write.parquet(f"{path}/lengths")
    ranges = _ranges(index.lengths.sparkSession.read.parquet(f"{path}/lengths"))
    index.postings.repartitionByRange(ranges, *order).sortWithinPartitions(*order, "col").write.parquet(f"{path}/postings")


#: Tokens of a range of terms, which one task sorts: few enough that it does so in memory.
RANGE = 1_000_000


def _ranges(lengths: DataFrame) -> int:
    """So many ranges that each has about ``RANGE`` tokens, and the session's tasks all have one."""
    return max(lengths.sparkSession.sparkContext.defaultParallelism, (lengths.agg(F.sum("doc_len")).first()[0] or 0) // RANGE + 1)


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))


#: Rows of a page of impacts, the least that a scan skips by its statistics.
PAGE_ROWS = 4096


def write_impacts(index: Index, path: str) -> None:
    """Blocks of documents and of postings; terms in ranges, so that a scan has few pages beside those it needs."""
    placed(index.lengths).write.parquet(f"{path}/places")
    places = index.lengths.sparkSession.read.parquet(f"{path}/places")
    # ranges are cut from a first look at all rows, so these are made before
    _write_blocks(places, written(impacts_of(index.postings, places)), path)


def write_impacts_of_tokens(tokens: DataFrame, path: str) -> None:
    """The same of a table of tokens, without its postings."""
    made = written(made_of(tokens))
    places = made.where("slot IS NOT NULL").select("project_name", "path", "doc_len", "block", "slot")
    _write_blocks(places, made.where("slot IS NULL").drop("slot", "project_name", "path", "doc_len"), path)


def _write_blocks(places: DataFrame, rows: DataFrame, path: str) -> None:
    blocks_of(places).write.parquet(f"{path}/blocks")
    order = ["whole", "term", "block"]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_.write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{path}/impacts")


def read_impacts(spark: SparkSession, path: str) -> Impacts:
    return Impacts(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/impacts"))


def tokenized(docs: DataFrame) -> DataFrame:
    """Token table of ``docs(project_name, path, body, ...)``, which is read once."""
    return token_index(spread(docs).withColumn("title", title(F.col("body"), F.col("path"))))


def answering(docs: DataFrame, clauses: list[Clause]) -> Index:
    """What one query reads of the index of ``docs(project_name, path, body, ...)``, which is read once."""
    return lexical.answering(spread(docs).withColumn("title", title(F.col("body"), F.col("path"))), clauses)


def _once(spark: SparkSession, sf_dir: str, kind: str, make) -> str:
    """Where what is made of ``documents`` is, written into the shared folder when a session first asks for it.

    It goes by the table's files, their sizes and times: a table that is written anew has another.
    """
    name = (spark.sparkContext.applicationId, shared_dir(spark), store.state_of(spark, f"{sf_dir}/documents.parquet"), kind)
    if name not in _MADE:
        path = fresh_path(spark, kind)
        make(path)
        _MADE[name] = path
    return _MADE[name]


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of tokens of ``documents``, which its indexes are made of."""
    return spark.read.parquet(_once(spark, sf_dir, "tokens", lambda path: tokenized(documents(spark, sf_dir)).drop("body").write.parquet(path)))


def keyword_index(spark: SparkSession, sf_dir: str, stemmed: bool = False) -> Index:
    """The index of ``documents``."""

    def from_text(path: str) -> None:
        tokens = _tokens(spark, sf_dir).withColumn("title_len", F.size("title_tokens")).withColumn("body_len", F.size("body_tokens"))
        write_index(inverted(tokens), path)

    plain = read_index(spark, _once(spark, sf_dir, "index", from_text))
    if not stemmed:
        return plain
    stems = _once(spark, sf_dir, "stems", lambda path: with_stems(plain).stems.write.parquet(path))
    return Index(plain.postings, plain.lengths, spark.read.parquet(stems))


def impact_index(spark: SparkSession, sf_dir: str) -> Impacts:
    """The index of ``documents`` in blocks."""
    return read_impacts(spark, _once(spark, sf_dir, "impacts", lambda path: write_impacts_of_tokens(_tokens(spark, sf_dir), path)))
