"""Folders of files as tables: listing, rules of what to skip, kinds of content, decoding.

Folders are paths that driver and executors see alike, such as a mounted store. The driver
lists the upper folders; what is below is listed and read by tasks.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from seekwell.functions.names import glob_regex

#: Never entered: version control, packages, and workspaces kept beside the files.
SKIPPED = (".git", ".hg", ".svn", "node_modules", ".seekwell")
IGNORE_FILE = ".gitignore"
SNIFFED = 8192
MOST_CONTROL = 0.02
#: Bytes of a file (offset, bytes, offset, bytes) and the kind that they tell, in order.
SIGNATURES = (
    (0, b"%PDF", 0, b"", "pdf"),
    (0, b"\x89PNG\r\n\x1a\n", 0, b"", "image"),
    (0, b"\xff\xd8\xff", 0, b"", "image"),
    (0, b"GIF87a", 0, b"", "image"),
    (0, b"GIF89a", 0, b"", "image"),
    (0, b"BM", 0, b"", "image"),
    (0, b"II*\0", 0, b"", "image"),
    (0, b"MM\0*", 0, b"", "image"),
    (0, b"RIFF", 8, b"WEBP", "image"),
    *((4, b"ftyp", 8, b, "image") for b in (b"avif", b"avis", b"heic", b"heix", b"hevc", b"hevx", b"mif1", b"msf1")),
    (0, b"RIFF", 8, b"WAVE", "audio"),
    (0, b"ID3", 0, b"", "audio"),
    (0, b"fLaC", 0, b"", "audio"),
    (0, b"RIFF", 8, b"AVI ", "video"),
    (4, b"ftyp", 0, b"", "video"),
    (0, b"\x1aE\xdf\xa3", 0, b"", "video"),
    (0, b"\0\0\x01\xba", 0, b"", "video"),
    (0, b"\0\0\x01\xb3", 0, b"", "video"),
)
_THEORA = b"\x80theora"


def kind_by_signature(head: bytes) -> str | None:
    for a, first, b, second, kind in SIGNATURES:
        if head[a : a + len(first)] == first and head[b : b + len(second)] == second and (a == 0 or len(head) >= 12):
            return kind
    if head.startswith(b"OggS"):
        return "video" if _THEORA in head else "audio"
    if len(head) > 1 and head[0] == 0xFF and head[1] >= 0xE0:  # the sync of an MPEG audio frame
        return "audio"
    return None


def few_controls(text: str) -> bool:
    control = sum((c < " " or "\x7f" <= c < "\xa0") and c not in "\t\n\r" for c in text)
    return control <= MOST_CONTROL * max(1, len(text))


def kind_of(head: bytes, whole: bool) -> str:
    """Kind of a file by its first bytes; empty is text, and so is UTF-8 with few control characters."""
    head = head[:SNIFFED]
    if kind := kind_by_signature(head):
        return kind
    for cut in range(1 if whole else 4):  # a character may be cut at the end of the sample
        try:
            text = head[: len(head) - cut].decode("utf-8")
        except UnicodeDecodeError:
            continue
        return "text" if few_controls(text) else "other"
    return "other"


def _segment(glob: str) -> str:
    """An ignore file's glob within path segments, as a regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c in "*?":
            out, i = out + ("[^/]*" if c == "*" else "[^/]"), i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            out, i = out + "[" + ("^" + glob[i + 2 : end] if glob[i + 1] in "!^" else glob[i + 1 : end]) + "]", end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def ignore_rules(text: str) -> list[tuple[str, bool, bool]]:
    """Rules (pattern, whether it excludes, whether only folders) of an ignore file, the last first."""
    rules = []
    for line in text.split("\n"):
        rule = re.sub(r"(?<!\\) +$", "", line.rstrip("\r"))
        if not rule or rule.startswith("#"):
            continue
        wanted, rule = rule.startswith("!"), rule.removeprefix("!")
        folder, rule = rule.endswith("/"), rule.rstrip("/")
        anchored, rule = "/" in rule, rule.removeprefix("/")
        if rule:
            rules.append((("" if anchored else "(?:.*/)?") + _segment(rule), not wanted, folder))
    return rules[::-1]


def ignored(frames: list[tuple[str, list]], path: str, folder: bool) -> bool:
    """Whether ignore files exclude a path; ``frames`` has (folder, rules) from the root on.

    Nearer folders go first, and in a file the last line that matches decides. What is below an
    excluded folder is never asked for.
    """
    for base, rules in reversed(frames):
        below = path[len(base) + 1 :] if base else path
        for pattern, excludes, folders_only in rules:
            if (folder or not folders_only) and re.fullmatch(pattern, below, re.DOTALL):
                return excludes
    return False


def walk(root: str, start: str, frames: list, use_ignore: bool, depth: int | None = None) -> Iterator[tuple]:
    """Files (path, time in ns, size) below a folder, and folders (path, None, frames) at a depth.

    Links to files are followed, to folders not. What can't be looked at is left out.
    """
    here = f"{root}/{start}" if start else root
    if use_ignore:
        try:
            with open(f"{here}/{IGNORE_FILE}", encoding="utf-8", errors="replace") as f:
                frames = [*frames, (start, ignore_rules(f.read()))]
        except OSError:
            pass
    try:
        entries = sorted(os.scandir(here), key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        path = f"{start}/{e.name}" if start else e.name
        try:
            if e.is_dir(follow_symlinks=False):
                if e.name in SKIPPED or (use_ignore and ignored(frames, path, True)):
                    continue
                if depth == 0:
                    yield path, None, frames
                else:
                    yield from walk(root, path, frames, use_ignore, None if depth is None else depth - 1)
            elif e.is_file() and not (use_ignore and ignored(frames, path, False)):
                s = e.stat()
                yield path, s.st_mtime_ns, s.st_size
        except OSError:
            continue


def listed(
    spark: SparkSession, root: str, include: tuple[str, ...] = ("**/*",), exclude: tuple[str, ...] = (), use_ignore: bool = True
) -> DataFrame:
    """``(path, source_mtime_ns, source_size_bytes)`` of the files below a folder; nothing is read.

    The driver lists two levels, tasks the folders below.
    """
    root = root.rstrip("/") or "/"
    wanted, unwanted = ([re.compile(glob_regex(g), re.DOTALL) for g in globs] for globs in (include, exclude))
    schema = "path string, source_mtime_ns long, source_size_bytes long"

    def chosen(path: str) -> bool:
        return any(g.match(path) for g in wanted) and not any(g.match(path) for g in unwanted)

    def below(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for folder, packed in zip(pdf["folder"], pdf["frames"], strict=True):
                frames = [(base, [tuple(r) for r in rules]) for base, rules in json.loads(packed)]
                rows, more = [], walk(root, folder, frames, use_ignore)
                for row in more:
                    if chosen(row[0]):
                        rows.append(row)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    names = [c.split()[0] for c in schema.split(", ")]
    upper = list(walk(root, "", [], use_ignore, 1))
    files = spark.createDataFrame([r for r in upper if r[1] is not None and chosen(r[0])], schema)
    folders = [(path, json.dumps(frames)) for path, t, frames in upper if t is None]
    if not folders:
        return files
    dealt = spark.createDataFrame(folders, "folder string, frames string").repartition(min(len(folders), 10_000))
    return files.unionByName(dealt.mapInPandas(below, schema))


def contents(files: DataFrame) -> DataFrame:
    """Adds ``file_type``, ``source_hash`` (of rich files) and ``body`` (of texts) to ``files(root, path, ...)``.

    Each file is read once. One that can't be read, isn't strict UTF-8 or has too many control
    characters is ``other``, with neither hash nor body.
    """

    def looked_at(full: str) -> tuple[str, str | None, str | None]:
        try:
            with open(full, "rb") as f:
                head = f.read(SNIFFED)
                kind = kind_of(head, len(head) < SNIFFED)
                if kind == "other":
                    return kind, None, None
                if kind == "text":
                    text = (head + f.read()).decode("utf-8")
                    return (kind, None, text) if few_controls(text) else ("other", None, None)
                digest = hashlib.sha256(head)
                while part := f.read(1 << 20):
                    digest.update(part)
                return kind, digest.hexdigest(), None
        except (OSError, UnicodeDecodeError):
            return "other", None, None

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in range(0, len(pdf), 64):
                some = pdf.iloc[at : at + 64]
                found = [looked_at(f"{root}/{path}") for root, path in zip(some["root"], some["path"], strict=True)]
                yield some.assign(**{c: [f[i] for f in found] for i, c in enumerate(("file_type", "source_hash", "body"))})

    schema = ", ".join(f"`{c}` {t}" for c, t in files.dtypes) + ", file_type string, source_hash string, body string"
    return files.mapInPandas(read, schema)
