"""Quality rules: fixed base rules, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are compared: one of trusted
documents, smoothed towards the other, which is that of the whole corpus. A document's
score is the mean of log(p_trusted / p_corpus) over its n-grams, so length does not
matter. Documents below a threshold are rejected; the threshold is the lower confidence
bound of a low quantile of the held-out scores of those trusted documents that pass the
base rules.

All of it is SQL expressions. The only thing sent to the tasks is the table of
``BUCKETS`` weights, whose size is fixed, as a literal in the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekwell.llm.common import read

BUCKETS = 10_000
#: Labelled documents that make up the trusted side, at most; the lowest by hash of their id.
MAX_TRUSTED = 20_000
#: This share of the trusted documents that pass the base rules scores below the quantile that the threshold is based on.
QUANTILE = 0.01
#: The threshold is lower than that quantile by what its estimate may be off: so many deviations of a score over the
#: root of their number. Of normal scores a quantile of 0.01 has a standard error of 3.7 such; two of these are taken.
ERRORS = 7.4
#: Deviation of scores that counts as one observation beside those of the documents, so that few don't look certain.
PRIOR_DEVIATION = 1.0
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

_SPACE = r"[\\x20\\x09-\\x0D]"
_WORDS = rf"""
    CASE WHEN text RLIKE '[^\\x20\\x09-\\x0D]'
         THEN split(trim(BOTH ' \t\n\u000B\u000C\r' FROM text), '{_SPACE}+')
         ELSE array() END"""
_GRAMS = f"""
    concat(transform(h, x -> cast(pmod(x, {BUCKETS}) AS int)),
           transform(slice(h, 2, size(h)), (x, i) -> cast(pmod(xxhash64(h[i], x), {BUCKETS}) AS int)))"""


def _hashed(docs: DataFrame) -> DataFrame:
    """Adds ``words`` and their hashes ``h``; a null text is empty."""
    return (
        docs.withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("words", F.expr(_WORDS))
        .withColumn("h", F.expr("transform(words, w -> xxhash64(w))"))
    )


def base_columns(hashed: DataFrame) -> DataFrame:
    """Adds the counts of the base rules.

    ``n_repeat_words`` counts the words that lie in some window of five words that the text
    has twice or more: the windows' hashes are sorted with their positions, those with an
    equal neighbour are kept, and the lengths up to the next kept position, five at most,
    are summed.
    """
    pick = ", ".join(f"h[i + {k}]" for k in range(WINDOW))
    return (
        hashed.withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", F.length(F.concat_ws("", "words")).cast("long"))
        .withColumn(
            "n_symbols",
            (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long"),
        )
        .withColumn("_lines", F.expr(rf"filter(split(text, '\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]')"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn(
            "_w",
            F.expr(
                f"CASE WHEN size(h) >= {WINDOW} THEN "
                f"transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({pick})) ELSE array() END"
            ),
        )
        .withColumn(
            "_s",
            F.expr(
                "CASE WHEN size(array_distinct(_w)) < size(_w) "
                "THEN sort_array(transform(_w, (x, i) -> struct(x AS x, i AS i))) ELSE array() END"
            ),
        )
        .withColumn(
            "_p",
            F.expr(
                "sort_array(transform(filter(_s, (p, j) -> (j > 0 AND p.x = _s[j - 1].x) "
                "OR (j + 1 < size(_s) AND p.x = _s[j + 1].x)), p -> p.i))"
            ),
        )
        .withColumn(
            "n_repeat_words",
            F.expr(
                f"aggregate(sequence(1, size(_p)), 0L, (n, j) -> n + CASE WHEN j >= size(_p) THEN {WINDOW} "
                f"ELSE least({WINDOW}, _p[j] - _p[j - 1]) END)"
            ),
        )
        .withColumn("n_repeat_words", F.expr("CASE WHEN size(_p) = 0 THEN 0L ELSE n_repeat_words END"))
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        )
        .drop("_lines", "_w", "_s", "_p")
    )


def trusted_ids(labels: DataFrame, most: int = MAX_TRUSTED) -> DataFrame:
    """Ids of documents of good quality that are not toxic; ``most`` of them, lowest by hash."""
    good = labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _weights(counts: list, good: list[int]) -> list[float]:
    """log(p_trusted / p_corpus) of each bucket; the trusted side is smoothed towards the corpus."""
    total, all_good = sum(r.n for r in counts), sum(good)
    out = [0.0] * BUCKETS
    for r, g in zip(counts, good, strict=True):
        p = r.n / total
        out[r.b] = round(math.log((g + BUCKETS * p) / (all_good + BUCKETS) / p), 6)
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRUSTED) -> tuple[list[float], float]:
    """Weights of the buckets, and the threshold.

    The corpus counts are of every document. For the threshold each half of the trusted
    documents is scored by weights that come from the other half, as documents are that the
    weights have not seen. The threshold is the lower confidence bound of the ``QUANTILE`` of
    those that pass the base rules, by one formula for any number of them. Without any the
    threshold is minus infinity: the base rules alone reject.
    """
    halves = trusted_ids(labels, most).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)))
    trusted = F.broadcast(halves)
    counts = (
        _hashed(docs.select("doc_id", "text").join(trusted, "doc_id", "left"))
        .select("half", F.explode(F.expr(_GRAMS)).alias("b"))
        .groupBy("b")
        .agg(F.count("*").alias("n"), *(F.count_if(F.col("half") == i).alias(f"good{i}") for i in (0, 1)))
        .collect()  # BUCKETS rows at most
    )
    both = _weights(counts, [r.good0 + r.good1 for r in counts])
    each = [_weights(counts, [r[f"good{i}"] for r in counts]) for i in (0, 1)]
    other = F.when(F.col("half") == 0, score(each[1])).otherwise(score(each[0]))
    scored = base_columns(_hashed(docs.select("doc_id", "text").join(trusted, "doc_id"))).withColumn("s", other)
    passing = F.when(~F.col("base_failed"), F.col("s"))
    # a generator, as in ``kept_documents``: the three uses would each have a copy of all expressions
    one = scored.select(F.explode(F.array(passing)).alias("s"))
    told = one.agg(F.count("s").alias("n"), F.percentile("s", F.lit(QUANTILE)).alias("low"), F.var_pop("s").alias("var")).first()
    return both, threshold(told.n, told.low, told.var) if told.n else -math.inf


def threshold(n: int, low: float, variance: float) -> float:
    """Lower confidence bound of the quantile ``low`` of n scores."""
    deviation = math.sqrt((n * variance + PRIOR_DEVIATION**2) / (n + 1))
    return round(low - ERRORS * deviation / math.sqrt(n), 6)


def score(weights: list[float]) -> Column:
    """Mean weight of a row's n-grams, in order of the text; zero where there are none."""
    table = f"cast(split('{','.join(f'{w:.6f}' for w in weights)}', ',') AS array<double>)"
    return F.expr(
        f"CASE WHEN size(h) = 0 THEN 0D ELSE round("
        f"aggregate({_GRAMS}, 0D, (s, g) -> s + {table}[g]) / (2 * size(h) - 1), 6) END"
    )


def judged(docs: DataFrame, labels: DataFrame, most: int = MAX_TRUSTED) -> DataFrame:
    """All rows and columns of ``docs`` with the base counts, ``base_failed``, ``score``, ``kept``.

    Null and wordless texts fail the base rules, as do all of under ten words. Repeated
    rows get equal results. Columns of ``docs`` that have a result's name are replaced; all
    others stay, whatever their names.
    """
    weights, threshold = fit(docs, labels, most)
    others = [c for c in docs.columns if c not in RESULTS]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), "text")
    marked = base_columns(_hashed(rows)).withColumn("score", score(weights))
    kept = ~F.col("base_failed") & (F.col("score") >= F.lit(threshold))
    return marked.withColumn("kept", kept).select("_row.*", *RESULTS)


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are kept, with the columns of ``docs`` as they were.

    The verdict is taken by a generator: a filter would be pushed below the columns that it
    is made from, with a copy of them for every use.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = judged(docs.select(row, "doc_id", "text"), labels).select("row", "kept")
    one = F.when(F.col("kept"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return marked.select("row", F.explode(one)).select("row.*")


def op10_quality_llr(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, read(spark, sf_dir, "labels")).select("doc_id", *COLUMNS)
