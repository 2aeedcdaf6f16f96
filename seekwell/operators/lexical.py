"""Keyword search: the token index, matching, and BM25 ranking over two columns.

An index is made once and searched often: ``postings`` has a row for each term, document and
column, sorted by term, so that a word's prefix is a range of terms that reaches the Parquet
scan; ``lengths`` has a row for each document. A search reads the postings of its terms only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from seekwell.functions.grammar import Atom, Clause, atoms, grams, is_gram, needs_text_check, normal
from seekwell.functions.stemming import stem, stemmed_vocabulary
from seekwell.functions.text import gram_count, nfkc, token_count, tokens
from seekwell.sources.shared import written

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
KEY = ["project_name", "path"]


def token_index(docs: DataFrame) -> DataFrame:
    """Adds ``title_tokens`` (of title and path), ``body_tokens`` and ``doc_len`` to documents."""
    both = F.struct(
        tokens(nfkc(F.concat("title", F.lit(" "), "path"))).alias("title_tokens"),
        tokens(nfkc(F.col("body"))).alias("body_tokens"),
    )
    # a generator of one row: filters on the tokens are not pushed below it, where each use would tokenize anew
    once = docs.select(*docs.columns, F.explode(F.array(both)).alias("_t")).select(*docs.columns, "_t.*")
    return once.withColumn("doc_len", F.size("title_tokens") + F.size("body_tokens"))


@dataclass
class Index:
    """``postings(term, project_name, path, col, tf, positions)`` and ``lengths(project_name, path, ..., doc_len)``."""

    postings: DataFrame
    lengths: DataFrame
    #: ``(term, stem)`` if queries go by stems without diacritics: postings stay by plain terms, and those of a query's stems are read.
    stems: DataFrame | None = None

    @property
    def stemmed(self) -> bool:
        return self.stems is not None

    def matching(self, test: Column) -> DataFrame:
        """Postings whose ``term``, its stem if queries go by stems, passes a test."""
        if self.stems is None:
            return self.postings.where(test)
        found = written(self.stems.select(F.col("term").alias("_plain"), F.col("stem").alias("term")).where(test))
        few = found.limit(FEW + 1).count() <= FEW
        return self.postings.withColumnRenamed("term", "_plain").join(F.broadcast(found) if few else found, "_plain").drop("_plain")


#: Up to so many terms are sent to all tasks.
FEW = 200_000


def inverted(index: DataFrame) -> Index:
    """The index of a table of tokens."""
    return Index(postings(index), index.drop("title_tokens", "body_tokens", "body"))


def with_stems(index: Index) -> Index:
    """The same index by stems; each distinct term is stemmed once, and postings are those of the plain index."""
    return Index(index.postings, index.lengths, stemmed_vocabulary(index.postings))


def atom_count(column: str, atom: Atom) -> Column:
    """Occurrences of an atom of one token in an array of tokens."""
    (first,) = atom.tokens
    test = (lambda t: t.startswith(first)) if atom.prefix else (lambda t: t == first)
    return F.size(F.filter(column, test))


def prefix_range(term: str) -> Column:
    """Terms with a prefix as a range, so that a sorted file can be skipped by its statistics."""
    low, last = F.col("term") >= term, term
    while last and ord(last[-1]) == 0x10FFFF:
        last = last[:-1]
    if not last:
        return low
    after = 0xE000 if ord(last[-1]) == 0xD7FF else ord(last[-1]) + 1
    return low & (F.col("term") < last[:-1] + chr(after))


def atom_counts(index: Index, wanted: list[Atom]) -> DataFrame:
    """``(project_name, path, _f0, _f1, ...)``: occurrences of atoms in documents that have any.

    Only postings of the atoms' terms are read. An atom of several tokens holds where they
    follow each other in one column: their positions, moved back by their place in the atom,
    are then equal.
    """
    tags = []
    for a, atom in enumerate(wanted):
        for i, t in enumerate(atom.tokens):
            is_it = prefix_range(t) if atom.prefix and i + 1 == len(atom.tokens) else F.col("term") == t
            tags.append((is_it, F.struct(F.lit(a).alias("atom"), F.lit(i).alias("at"))))
    found = index.matching(reduce(or_, (c for c, _ in tags))).select(
        *KEY, "col", "tf", "positions", F.inline(F.array_compact(F.array(*(F.when(c, t) for c, t in tags))))
    )
    several = [i for i, a in enumerate(wanted) if len(a.tokens) > 1]
    counts = found.where(~F.col("atom").isin(several)) if several else found
    counts = counts.select(*KEY, "atom", F.col("tf").cast("long").alias("n"))
    if several:
        most = max(len(wanted[a].tokens) for a in several)
        # a column of a document is one row, with the places where each word of the atom says that it begins
        begin = F.transform("positions", lambda p: p - F.col("at"))
        gathered = found.where(F.col("atom").isin(several)).select(*KEY, "atom", "col", "at", begin.alias("begin")).groupBy(*KEY, "atom", "col").agg(
            *(F.flatten(F.collect_list(F.when(F.col("at") == i, F.col("begin")))).alias(f"_b{i}") for i in range(most))
        )
        whole = F.element_at(F.array(*(F.lit(len(a.tokens)) for a in wanted)), F.col("atom") + 1)
        both = F.col("_b0")
        for i in range(1, most):
            both = F.when(whole > i, F.array_intersect(both, F.col(f"_b{i}"))).otherwise(both)
        counts = counts.unionByName(gathered.select(*KEY, "atom", F.size(both).cast("long").alias("n")).where("n > 0"))
    columns = [F.coalesce(F.sum(F.when(F.col("atom") == a, F.col("n"))), F.lit(0)).alias(f"_f{a}") for a in range(len(wanted))]
    return counts.groupBy(*KEY).agg(*columns)


def _as_indexed(index: Index, atom: Atom) -> Atom:
    return Atom(tuple(map(stem, atom.tokens)), atom.prefix) if index.stemmed else atom


def text_check(body: Column, clauses: list[Clause]) -> Column:
    """Whether a text has each phrase of a script without spaces that it should, and no excluded one."""
    plain, ok = F.lower(nfkc(body)), F.lit(True)
    for clause in filter(needs_text_check, clauses):
        has = plain.contains(normal(clause.text).lower())
        ok = ok & (~has if clause.excluded else has)
    return ok


def bm25_topk(index: Index, clauses: list[Clause], limit: int | None, scope: list[str] | None = None, bodies: DataFrame | None = None) -> DataFrame:
    """``(project_name, path, raw_bm25, score)`` of matching documents, best (lowest ``raw_bm25``) first.

    An atom may match in either column. Document frequencies, the number of documents and
    their mean length are those of the whole index; ``scope`` only says which projects are
    returned. The statistics are one row, and the limit is a top-k of each task before the
    merge. ``bodies(project_name, path, body)`` is read, for documents that match, if a
    phrase has a script without spaces; the limit counts what its check lets through.
    """
    positive = [_as_indexed(index, a) for c in clauses if not c.excluded for a in atoms(c)]
    refused = [[_as_indexed(index, a) for a in atoms(c)] for c in clauses if c.excluded]
    wanted = [*positive, *(a for some in refused for a in some)]
    counted = atom_counts(index, wanted)
    ok, at = F.lit(True), len(positive)
    for i in range(len(positive)):
        ok = ok & (F.col(f"_f{i}") > 0)
    for some in refused:
        if some:
            ok = ok & (F.least(F.lit(1), *(F.col(f"_f{at + i}") for i in range(len(some)))) == 0)
            at += len(some)
    frequencies = counted.agg(*(F.count_if(F.col(f"_f{i}") > 0).alias(f"_df{i}") for i in range(len(positive))))
    whole = index.lengths.agg(F.count("*").alias("_n"), F.avg("doc_len").alias("_mean"))
    score = F.lit(0.0)
    for i in range(len(positive)):
        df = F.col(f"_df{i}")
        idf = F.greatest(F.log((F.col("_n") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        f = F.col(f"_f{i}").cast("double")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("doc_len") / F.col("_mean")))
    hits = counted.where(ok)
    if scope is not None:
        hits = hits.where(F.col("project_name").isin(scope))
    if any(map(needs_text_check, clauses)):
        if bodies is None:
            raise ValueError("a phrase of this script is checked on the bodies")
        hits = hits.join(bodies.select(*KEY, "body"), KEY).where(text_check(F.col("body"), clauses)).drop("body")
    ranked = (
        hits.join(index.lengths.select(*KEY, "doc_len"), KEY)
        .crossJoin(F.broadcast(frequencies))
        .crossJoin(F.broadcast(whole))
        .select(*KEY, (-score).alias("raw_bm25"))
    )
    out = ranked.withColumn("score", public_score(F.col("raw_bm25"))).orderBy("raw_bm25", *KEY)
    return out if limit is None else out.limit(limit)


def idf(n: int, df: int) -> float:
    """The weight of a word that ``df`` of ``n`` documents have."""
    return max(math.log((n - df + 0.5) / (df + 0.5)), LEAST_IDF)


def best_first() -> WindowSpec:
    """The order of hits of one search, which its limit bounds."""
    return W.partitionBy(F.lit(1)).orderBy("raw_bm25", *KEY)


def public_score(raw: Column) -> Column:
    """|b| / (1 + |b|); 0 for no number, 1 for infinity."""
    size = F.abs(raw)
    return (
        F.when(F.isnan(raw) | raw.isNull(), 0.0).when(size == float("inf"), 1.0).otherwise(size / (1 + size))
    )


#: Most tokens that one step of a task groups.
STEP = 2_000_000


def _steps(batch: pa.RecordBatch, sides: tuple[str, ...], step: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``step`` tokens each, one row at least."""
    ends = sum(pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in sides).cumsum()
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + step, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _places(rows: pa.RecordBatch, side: str, wanted: list[Atom] | None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of a column, and row, term and position of its tokens, of wanted ones only."""
    lists = rows.column(side)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    found = lists.flatten().dictionary_encode()
    code = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    pos = np.arange(len(code)) - np.repeat(sizes.cumsum() - sizes, sizes)
    if wanted is not None:
        terms = found.dictionary
        good = pc.is_in(terms, pa.array(sorted({t for a in wanted for t in a.tokens}), terms.type)).to_numpy(zero_copy_only=False)
        for a in wanted:
            if a.prefix:
                good = good | pc.starts_with(terms, a.tokens[-1]).to_numpy(zero_copy_only=False)
        keep = np.flatnonzero(good[code]) if len(code) else np.zeros(0, np.int64)
        code, row, pos = code[keep], row[keep], pos[keep]
    return found.dictionary, row, code, pos


def placed_terms(rows: pa.RecordBatch, side: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of a column, and row and term of its tokens."""
    return _places(rows, side, None)[:3]


def _posted(rows: pa.RecordBatch, col: int, wanted: list[Atom] | None) -> pa.RecordBatch:
    """Postings of one column of token rows."""
    terms, row, code, pos = _places(rows, _SIDES[col], wanted)
    name = row * max(1, len(terms)) + code
    order = np.argsort(name, kind="stable")
    name = name[order]
    begin = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
    ends = np.append(begin, len(name)).astype(np.int32)
    first = order[begin]
    arrays = [
        terms.take(pa.array(code[first])),
        *(rows.column(k).take(pa.array(row[first])) for k in KEY),
        pa.array(np.full(len(begin), col, np.int8)),
        pa.array(np.diff(ends).astype(np.int32)),
        pa.ListArray.from_arrays(pa.array(ends), pa.array(pos[order].astype(np.int32))),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=_POSTING_NAMES)


_SIDES = ("title_tokens", "body_tokens")
_POSTING = "term string, project_name string, path string, col tinyint, tf int, positions array<int>"
_POSTING_NAMES = [c.split()[0] for c in _POSTING.split(", ")]


def postings(index: DataFrame) -> DataFrame:
    """A row for each term, document and column: its count and positions. A document is one row, so nothing is shuffled."""

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _steps(batch, _SIDES, STEP):
                for col in range(len(_SIDES)):
                    yield _posted(rows, col, None)

    return index.select(*KEY, *_SIDES).mapInArrow(posted, _POSTING)


#: The column of a row that tells a document's length.
_LENGTH = -1


def answering(docs: DataFrame, clauses: list[Clause]) -> Index:
    """The part of the index of ``docs(project_name, path, title, body)`` that a query reads, for a table searched once.

    Texts are gone through once; postings of other terms are never made, and of n-grams of scripts without
    spaces only counts are.
    """
    wanted = [a for c in clauses for a in atoms(c)]
    if all(len(a.tokens) == 1 and not a.prefix and is_gram(a.tokens[0]) for a in wanted):
        texts = F.struct(nfkc(F.concat("title", F.lit(" "), "path")).alias("t0"), nfkc(F.col("body")).alias("t1"))
        rows = docs.select(*KEY, F.explode(F.array(texts)).alias("_t")).select(*KEY, "_t.*")
        none = F.lit(None).cast("array<int>").alias("positions")
        row = lambda term, col, n: F.struct(F.lit(term).cast("string").alias("term"), F.lit(col).cast("tinyint").alias("col"), n.cast("int").alias("tf"), none)
        grams = sorted({a.tokens[0] for a in wanted})
        each = [row(None, _LENGTH, token_count(F.col("t0")) + token_count(F.col("t1"))), *(row(g, i, gram_count(F.col(f"t{i}"), g)) for g in grams for i in (0, 1))]
        made = rows.select(*KEY, F.inline(F.array(*each))).where(f"col = {_LENGTH} OR tf > 0").select(*_POSTING_NAMES)
    else:

        def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                own = [pa.nulls(n, pa.string()), *(batch.column(k) for k in KEY), pa.array(np.full(n, _LENGTH, np.int8)), batch.column("doc_len"), pa.nulls(n, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(own, names=_POSTING_NAMES)
                for rows in _steps(batch, _SIDES, STEP):
                    for col in range(len(_SIDES)):
                        yield _posted(rows, col, wanted)

        made = token_index(docs).select(*KEY, *_SIDES, "doc_len").mapInArrow(posted, _POSTING)
    made = written(made)
    return Index(made.where(F.col("col") != _LENGTH), made.where(F.col("col") == _LENGTH).select(*KEY, F.col("tf").alias("doc_len")))


def _grams_of(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The n-grams of each row's runs with their number; a run's are made once."""
    terms, row, code, _ = _places(rows, "runs", None)
    runs = terms.to_pylist()
    pair, times = np.unique(row * max(1, len(runs)) + code, return_counts=True)
    row, code = pair // max(1, len(runs)), pair % max(1, len(runs))
    ids: dict[str, int] = {}
    own = [[ids.setdefault(g, len(ids)) for g in grams(r)] for r in runs]
    sizes = np.array([len(o) for o in own], np.int64)
    flat = np.array([g for o in own for g in o], np.int64)
    n = sizes[code]
    at = np.repeat((sizes.cumsum() - sizes)[code], n) + np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
    name, place = np.unique(np.repeat(row, n) * max(1, len(ids)) + flat[at], return_inverse=True)
    found = np.bincount(place, np.repeat(times, n), len(name)).astype(np.int64)
    row, gram = name // max(1, len(ids)), name % max(1, len(ids))
    return pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(row)), pa.array(list(ids), pa.string()).take(pa.array(gram)), pa.array(found)], names=["doc_id", "gram", "n"])


def gram_totals(runs: DataFrame) -> DataFrame:
    """``(gram, n, docs)`` of ``runs(doc_id, runs)``: occurrences of n-grams, and documents that have them.

    A row has each of its n-grams once before anything is shuffled.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _steps(batch, ("runs",), STEP // 8):
                yield _grams_of(rows)

    own = runs.select(F.col("doc_id").cast("long").alias("doc_id"), "runs").mapInArrow(counted, "doc_id long, gram string, n long")
    return own.groupBy("doc_id", "gram").agg(F.sum("n").alias("n")).groupBy("gram").agg(F.sum("n").alias("n"), F.count("doc_id").alias("docs"))


def vocabulary(index: Index) -> DataFrame:
    """Terms of bodies with the documents and occurrences that have them."""
    return index.postings.where("col = 1").groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").cast("long").alias("occurrences"))
