"""Texts of rich files: what waits, a plug-in that reads it, and what its outcome does to the registry."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekwell.functions.text import non_blank

RICH = ("pdf", "image", "audio", "video")
#: Kinds that one recipe makes.
RECIPE_KINDS = {"pdf": ("pdf",), "image": ("image",), "media": ("audio", "video")}
#: How short and how long an answer may be, and how answers begin.
LEAST_SHARE, MOST_TIMES, MOST_MORE = 4, 3, 200
_OPENINGS = ("here is the result:", "here's the result:", "sure:", "sure,", "result:")

_GREETING = rf"\s*(?:{'|'.join(map(re.escape, _OPENINGS))})?\s*"
_ANSWER = re.compile(rf"{_GREETING}(?:```[^\n]*\n{_GREETING}(?P<fenced>.*)```.*|(?P<plain>.*))", re.DOTALL | re.IGNORECASE)


def work(docs: DataFrame, kinds: list[str] = RICH) -> DataFrame:
    """Pending documents of the kinds, with a source."""
    waits = (F.col("extraction_status") == "pending") & F.col("source_hash").isNotNull() & F.col("file_type").isin(list(kinds))
    return docs.where(waits).select("project_name", "path", "file_type", "source_hash")


def extracted(files: DataFrame, extract: Callable[[str, str], tuple[str | None, str]]) -> DataFrame:
    """Runs ``extract(full path, kind)``, which gives a text and the hash of what it read, on work with ``root``.

    Gives ``(project_name, path, outcome, body, reason)``: ``extracted``; ``failed`` if it raised or
    gave no text; ``skipped`` if the source isn't the one that was listed. One file's failure
    fails that file only.
    """

    def outcome(full: str, kind: str, listed: str) -> tuple[str, str | None, str | None]:
        try:
            body, seen = extract(full, kind)
        except Exception as e:
            return "failed", None, str(e) or type(e).__name__
        if not (body or "").strip():
            return "failed", None, "no text"
        return ("extracted", body.strip(), None) if seen == listed else ("skipped", None, "the source changed")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                found = outcome(f"{row.root}/{row.path}", row.file_type, row.source_hash)
                yield pd.DataFrame([(row.project_name, row.path, *found)], columns=names)

    schema = "project_name string, path string, outcome string, body string, reason string"
    names = [c.split()[0] for c in schema.split(", ")]
    return files.select("root", "project_name", "path", "file_type", "source_hash").mapInPandas(run, schema)


def published(docs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The registry after outcomes: extracted documents are ready, failed ones have no content, others stay.

    A document that is ready with the same content is only touched: its time of update is now, as of all that change.
    """
    found = outcomes.select("project_name", "path", "outcome", F.sha2("body", 256).alias("_hash"))
    joined = docs.join(found, ["project_name", "path"], "left")
    done, failed = F.coalesce(F.col("outcome") == "extracted", F.lit(False)), F.coalesce(F.col("outcome") == "failed", F.lit(False))
    columns = {
        "content_hash": F.when(done, F.col("_hash")).when(failed, F.lit(None)).otherwise(F.col("content_hash")),
        "extraction_status": F.when(done, "ready").when(failed, "failed").otherwise(F.col("extraction_status")),
        "updated_at": F.when(done | failed, F.current_timestamp()).otherwise(F.col("updated_at") if "updated_at" in docs.columns else F.lit(None)),
    }
    return joined.select(*(columns.get(c, F.col(c)).alias(c) for c in docs.columns))


def new_contents(outcomes: DataFrame) -> DataFrame:
    texts = outcomes.where("outcome = 'extracted'").where(non_blank(F.col("body")))
    return texts.select(F.sha2("body", 256).alias("content_hash"), "body").dropDuplicates(["content_hash"])


def cleaned_text(original: str, given: str, answer: str | None) -> str:
    """A model's clean-up of the first part ``given`` of a text, or the text itself if the answer can't be one.

    A greeting and a fence around it are no part of an answer. One much shorter or longer is none.
    """
    found = _ANSWER.fullmatch(answer or "")
    text = (found["fenced"] if found["fenced"] is not None else found["plain"]).strip()
    sized = max(1, len(given.strip()) // LEAST_SHARE) <= len(text) <= MOST_TIMES * len(given) + MOST_MORE
    return text + original[len(given) :] if text and sized else original
