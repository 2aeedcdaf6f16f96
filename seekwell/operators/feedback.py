"""What the corpus itself adds to a search: words of the first hits, and how near each other a hit has the query's words."""

from __future__ import annotations

from functools import reduce
from operator import or_

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seekwell.functions.grammar import Atom, word_tokens
from seekwell.functions.text import best_line, lines, snippet
from seekwell.operators.hybrid import Expansion
from seekwell.operators.lexical import B, K1, KEY, LEAST_IDF, Index, prefix_range, token_index

#: Hits that are taken to answer a query, words that they add, and how many of these a ranking of their own gets.
HITS, WORDS, LEX = 10, 10, 3


def parse_expansion(text: str) -> Expansion:
    """An expansion from a model's lines ``type: text``.

    Types are ``lex``, ``vec`` and ``hyde`` in any case; other lines and lines without text are passed over, and
    runs of spaces become one.
    """
    found: dict[str, list[str]] = {"lex": [], "vec": [], "hyde": []}
    for line in regex.split(r"\R", text or ""):
        kind, colon, said = line.partition(":")
        said = " ".join(said.split())
        if colon and said and kind.strip().lower() in found:
            found[kind.strip().lower()].append(said)
    return Expansion(**{k: tuple(v) for k, v in found.items()})


def words_of(query: str) -> list[Atom]:
    """Each word of a query once, as the start of a word."""
    return [Atom((t,), True) for t in dict.fromkeys(word_tokens(query))]


def _idf(n, df):
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def _counted(index: Index, words: list[Atom]) -> DataFrame:
    """``(atom, project_name, path, f, positions)``: postings of bodies and titles by word."""
    tags = [(prefix_range(a.tokens[0]), F.lit(i)) for i, a in enumerate(words)]
    found = index.postings.where(reduce(or_, (c for c, _ in tags)))
    return found.withColumn("atom", F.explode(F.array_compact(F.array(*(F.when(c, t) for c, t in tags)))))


def first_hits(index: Index, words: list[Atom], limit: int = HITS, scope: list[str] | None = None) -> DataFrame:
    """``(project_name, path, score)``: documents with any of the words, by BM25, the best first."""
    fs = _counted(index, words).groupBy("atom", *KEY).agg(F.sum("tf").cast("double").alias("f"))
    dfs = fs.groupBy("atom").agg(F.count("*").alias("df"))
    whole = index.lengths.agg(F.count("*").alias("n"), F.avg("doc_len").alias("mean"))
    part = _idf(F.col("n"), F.col("df")) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("doc_len") / F.col("mean")))
    if scope is not None:
        fs = fs.where(F.col("project_name").isin(scope))
    rows = fs.join(F.broadcast(dfs), "atom").join(index.lengths.select(*KEY, "doc_len"), KEY).crossJoin(F.broadcast(whole))
    hits = rows.groupBy(*KEY).agg(F.round(F.sum(part), 9).alias("score"))
    return hits.orderBy(F.desc("score"), *KEY).limit(limit)


def expansion_terms(index: Index, docs: DataFrame, query: str, hits: DataFrame | None = None, scope: list[str] | None = None, limit: int = WORDS) -> DataFrame:
    """``(term, weight, docs)`` of what the first hits say beside the query, the heaviest first.

    A word's weight is its share of each hit's words, summed over the hits by their scores, times its idf. Words of
    the query, of fewer than three characters or with a digit are left out, and so are words that a single document has.
    ``docs(project_name, path, title, body)`` is read for the hits; the index gives frequencies of the words
    they have.
    """
    words = words_of(query)
    hits = first_hits(index, words, HITS, scope) if hits is None else hits
    texts = token_index(docs.join(F.broadcast(hits), KEY))
    said = texts.select("score", F.size("body_tokens").alias("size"), F.explode("body_tokens").alias("term"))
    known = reduce(or_, (F.col("term").startswith(a.tokens[0]) for a in words), F.lit(False))
    said = said.where(~known & (F.length("term") >= 3) & ~F.col("term").rlike(r"\p{Nd}"))
    shares = said.groupBy("term").agg(F.sum(F.col("score") / F.col("size")).alias("share"))
    dfs = index.postings.where("col = 1").join(shares.select("term"), "term").groupBy("term").agg(F.count("*").alias("docs"))
    whole = index.lengths.agg(F.count("*").alias("n"))
    weight = F.round(F.col("share") * _idf(F.col("n"), F.col("docs")), 9)
    rows = shares.join(dfs.where("docs > 1"), "term").crossJoin(F.broadcast(whole)).select("term", weight.alias("weight"), "docs")
    return rows.orderBy(F.desc("weight"), "term").limit(limit)


def from_corpus(index: Index, docs: DataFrame, scope: list[str] | None = None):
    """An expansion by relevance feedback: what ``hybrid.candidates`` asks for where there is no model.

    The heaviest words get rankings of their own, the query with all of them is embedded, and so are the lines of the
    best hit that have most of them. A query of which the corpus has no word has no expansion.
    """

    def expand(text: str) -> Expansion:
        query, _, intent = text.partition("\nQuery intent: ")
        words = words_of(f"{query} {intent}")
        if not words:
            return Expansion()
        hits = first_hits(index, words, HITS, scope)
        best = [(r["project_name"], r["path"], r["score"]) for r in hits.collect()]
        if not best:
            return Expansion()
        hits = docs.sparkSession.createDataFrame(best, "project_name string, path string, score double")
        terms = [r["term"] for r in expansion_terms(index, docs, f"{query} {intent}", hits).collect()]
        asked = [(a.tokens[0], 1.0) for a in words] + [(t, 0.5) for t in terms]
        (project, path, _), ls = best[0], lines(F.col("body"))
        one = docs.where((F.col("project_name") == project) & (F.col("path") == path)).select(ls.alias("ls"))
        said = one.withColumn("at", best_line(F.col("ls"), asked)).select(snippet(F.col("ls"), F.col("at")).alias("s")).first()
        terms = terms or [a.tokens[0] for a in words]
        hyde = " ".join(said["s"].split()) if said and said["s"] else ""
        return Expansion(tuple(terms[:LEX]), (" ".join([query.strip(), *terms]),), (hyde or " ".join(terms),))

    return expand


def proximity(index: Index, query: str, docs: DataFrame) -> DataFrame:
    """``(project_name, path, present, span, closeness)`` of ``docs(project_name, path)``.

    ``present`` is how many of the query's words the body has, ``span`` the length of the shortest stretch of it that
    has all of these, from the positions in the index. ``closeness``, 0 to 1, is the share of the words that are
    present, each by its idf, of which half depends on how full of them the stretch is. Documents without any word
    have 0, and no span.
    """
    words = words_of(query)
    if not words:
        return docs.select(*KEY, F.lit(0).alias("present"), F.lit(None).cast("int").alias("span"), F.lit(0.0).alias("closeness"))
    found = _counted(index, words).where("col = 1")
    dfs = found.groupBy("atom").agg(F.count_distinct(*KEY).alias("df"))
    count = index.lengths.agg(F.count("*").alias("n"))
    idfs = dfs.crossJoin(F.broadcast(count)).select("atom", _idf(F.col("n"), F.col("df")).alias("idf"))  # a row a word
    own = docs.select(*KEY).distinct()
    places = found.join(own, KEY).select(*KEY, "atom", F.explode("positions").alias("pos")).distinct()
    so_far = W.partitionBy(*KEY).orderBy("pos").rangeBetween(W.unboundedPreceding, W.currentRow)
    last = [F.last(F.when(F.col("atom") == i, F.col("pos")), ignorenulls=True).over(so_far).alias(f"_l{i}") for i in range(len(words))]
    ends = places.select(*KEY, "pos", *last)
    n = reduce(lambda a, b: a + b, (F.col(f"_l{i}").isNotNull().cast("int") for i in range(len(words))))
    first = F.array_min(F.array_compact(F.array(*(F.col(f"_l{i}") for i in range(len(words))))))
    spans = ends.select(*KEY, n.alias("present"), (F.col("pos") - first + 1).alias("span"))
    spans = spans.groupBy(*KEY).agg(F.min(F.struct((-F.col("present")).alias("p"), "span")).alias("s")).select(*KEY, (-F.col("s.p")).alias("present"), "s.span")
    held = places.select(*KEY, "atom").distinct().join(F.broadcast(idfs), "atom").groupBy(*KEY).agg(F.sum("idf").alias("held"))
    whole = idfs.agg(F.sum("idf").alias("all"), F.count("*").alias("known")).crossJoin(F.broadcast(count))
    share = F.col("held") / (F.col("all") + (F.lit(len(words)) - F.col("known")) * _idf(F.col("n"), F.lit(0)))
    full = (1 + F.col("present") / F.col("span")) / 2
    scored = spans.join(held, KEY).crossJoin(F.broadcast(whole)).select(*KEY, "present", "span", F.round(share * full, 9).alias("closeness"))
    return own.join(scored, KEY, "left").select(
        *KEY, F.coalesce("present", F.lit(0)).alias("present"), "span", F.coalesce("closeness", F.lit(0.0)).alias("closeness")
    )
