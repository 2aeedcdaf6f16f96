"""Identifiers, names, paths, globs and sizes: small pure functions for the driver."""

from __future__ import annotations

import hashlib
import re
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekwell.schemas import SCHEME


class EngineError(Exception):
    """A failure with a code that callers can tell apart."""

    def __init__(self, code: str, message: str, remediation: str = "") -> None:
        super().__init__(message)
        self.code, self.remediation = code, remediation


def doc_id(content_hash: Column) -> Column:
    return F.concat(F.lit("@"), F.substring(content_hash, 1, 6))


def virtual_path(project: Column, path: Column) -> Column:
    return F.concat(F.lit(f"{SCHEME}://"), project, F.lit("/"), path)


def parse_virtual_path(text: str) -> tuple[str, str]:
    """Project and path of a virtual path; the scheme may be left out."""
    project, _, path = text.removeprefix(f"{SCHEME}://").partition("/")
    return project, path


def recipe_id(*parts: str) -> str:
    """SHA-256 over each part's length as four bytes, and its bytes."""
    digest = hashlib.sha256()
    for raw in (p.encode() for p in parts):
        digest.update(struct.pack(">I", len(raw)) + raw)
    return digest.hexdigest()


def cache_key(operation: str, recipe: str, input_hash: str, space: str = "processing-cache") -> bytes:
    return bytes.fromhex(recipe_id(space, "v1", operation, recipe, input_hash))


def canonical_project(name: str) -> str:
    """Letters, digits, ``_`` and ``-`` stay; every other run becomes one ``-``; the ends are stripped."""
    kept = re.sub(r"[^\w-]+", "-", name)
    return kept.strip("-_")


def valid_path(path: str) -> bool:
    return bool(path) and "\0" not in path and not any(p in ("", ".", "..") for p in path.split("/"))


def glob_regex(glob: str) -> str:
    """A glob as a regular expression: ``*`` and ``?`` stay within a segment, ``**`` does not.

    A leading ``**/`` also matches nothing.
    """
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] in "*?":
            out, i = out + ("[^/]*" if glob[i] == "*" else "[^/]"), i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


_UNITS = {"": 1, "B": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9, "KIB": 2**10, "MIB": 2**20, "GIB": 2**30}


def parse_size(text: str) -> int:
    """Bytes of a size such as ``64KiB``; at least one."""
    m = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]*)\s*", text)
    if not m or m[2].upper() not in _UNITS or not (n := int(m[1]) * _UNITS[m[2].upper()]):
        raise EngineError("INVALID_REQUEST", f"not a size: {text!r}")
    return n


def csv_cell(value: object) -> str:
    text = "" if value is None else str(value)
    return '"' + text.replace('"', '""') + '"' if re.search(r'[",\r\n]', text) else text


def score_text(score: float) -> str:
    """Four decimals without trailing zeros."""
    return f"{score:.4f}".rstrip("0").rstrip(".")
