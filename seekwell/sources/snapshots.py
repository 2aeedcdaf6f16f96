"""Tables of a workspace as immutable snapshots that share the files which a change leaves alone."""

from __future__ import annotations

import json
import os
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekwell.functions.names import EngineError
from seekwell.operators import segments
from seekwell.operators.segments import Segment
from seekwell.schemas import SCHEMA_ID
from seekwell.sources import store

MOST_BUCKETS = 4096


class Workspace:
    """A folder of any store with ``data``, ``manifests/<id>.json`` and ``CURRENT``, which names the manifest to read.

    A table's rows are in buckets by a hash of its key. A manifest names the folder of each bucket, so
    that a new one has the folders of untouched buckets in common with the last; a table of
    segments has a list of these. Readers resolve the pointer once, so they see one state; a writer
    publishes all tables of a snapshot by replacing the pointer. The number of buckets is set when
    a table is written whole, for ``bucket_rows`` rows each.
    """

    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = 50_000) -> None:
        self.spark, self.path, self.bucket_rows = spark, path, bucket_rows

    def current(self) -> dict | None:
        found = store.read_text(self.spark, f"{self.path}/CURRENT")
        if found is None:
            return None
        named = json.loads(found)
        whole = store.read_text(self.spark, f"{self.path}/manifests/{named['id']}.json")
        return named if whole is None else json.loads(whole)

    def status(self) -> str:
        """``missing``, ``unreadable``, ``incompatible`` (of other schemas) or ``ready``."""
        try:
            now = self.current()
        except Exception:
            return "unreadable"
        if now is None:
            return "missing"
        return "ready" if now.get("schema") == SCHEMA_ID else "incompatible"

    def recipes(self) -> dict[str, str]:
        now = self.current()
        return now["meta"] if now and now.get("schema") == SCHEMA_ID else {}

    def read(self, table: str, keys: DataFrame | None = None) -> DataFrame | None:
        """A table of the current snapshot; none of one with other schemas.

        With ``keys`` only the buckets are read that can have these keys.
        """
        now = self.current()
        if not now or table not in now["tables"] or now.get("schema") != SCHEMA_ID:
            return None
        return self._opened(now["tables"][table], keys)

    def _opened(self, entry: dict, keys: DataFrame | None = None) -> DataFrame:
        if "segments" in entry:
            return segments.live(self.opened_segments(entry), entry["on"])
        wanted = entry["parts"]
        if keys is not None:
            touched = {r[0] for r in keys.select(_bucket(entry).alias("b")).distinct().collect()}
            wanted = {b: p for b, p in wanted.items() if int(b) in touched}
        return self._files(list(wanted.values()), entry["ddl"])

    def opened_segments(self, entry: dict) -> list[Segment]:
        marks = ", ".join(c for c in entry["ddl"].split(", ") if c.split(" ")[0] in entry["on"])
        return [Segment(self._files([s["rows"]], entry["ddl"]), self._files([s["gone"]], marks) if s["gone"] else None) for s in entry["segments"]]

    def _files(self, paths: list[str], ddl: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(*(f"{self.path}/{p}" for p in sorted(paths)))

    def building(self) -> Snapshot:
        return Snapshot(self, uuid.uuid4().hex)

    @contextmanager
    def writing(self, owner: str):
        """Hold the only write lock, or fail at once."""
        lock = f"{self.path}/LOCK"
        if not store.write_text(self.spark, lock, json.dumps({"owner": owner, "pid": os.getpid()}), overwrite=False):
            raise EngineError("BUSY", f"{self.path} is being written", "wait for the other writer")
        try:
            yield self
        finally:
            store.delete(self.spark, lock)

    def collect(self, keep: int = 1) -> int:
        """Delete the files that none of the last ``keep`` snapshots has; returns how many folders went.

        Readers of older snapshots lose them. The caller holds the write lock.
        """
        now, kept = self.current(), []
        while now and len(kept) < keep:
            kept.append(now)
            before = now.get("before") and store.read_text(self.spark, f"{self.path}/manifests/{now['before']}.json")
            now = json.loads(before) if before else None
        used = {p for m in kept for e in m["tables"].values() for p in _folders(e)}
        gone = 0
        for name in store.children(self.spark, f"{self.path}/manifests"):
            if name.removesuffix(".json") not in {m["id"] for m in kept}:
                store.delete(self.spark, f"{self.path}/manifests/{name}")
        for table in store.children(self.spark, f"{self.path}/data"):
            for written in store.children(self.spark, f"{self.path}/data/{table}"):
                folder = f"data/{table}/{written}"
                if not any(p == folder or p.startswith(f"{folder}/") for p in used):
                    store.delete_folder(self.spark, f"{self.path}/{folder}")
                    gone += 1
                    continue
                for part in store.children(self.spark, f"{self.path}/{folder}"):
                    if part.startswith("_b=") and f"{folder}/{part}" not in used:
                        store.delete_folder(self.spark, f"{self.path}/{folder}/{part}")
                        gone += 1
        return gone


def _folders(entry: dict) -> list[str]:
    if "segments" in entry:
        return [p for s in entry["segments"] for p in (s["rows"], s["gone"]) if p]
    return list(entry["parts"].values())


def _bucket(entry: dict) -> Column:
    return F.pmod(F.xxhash64(*entry["on"]), F.lit(entry["n"])).cast("int")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


class Snapshot:
    """A snapshot in the making. Each table is written whole or changed; what isn't is left out."""

    def __init__(self, workspace: Workspace, name: str) -> None:
        self.workspace, self.name, self.tables = workspace, name, {}
        now = workspace.current()
        self.last = now if now and now.get("schema") == SCHEMA_ID else None

    def step(self, name: str, df: DataFrame) -> DataFrame:
        """A table on the way, which goes once the snapshot is published."""
        path = f"{self.workspace.path}/steps/{self.name}/{name}"
        df.write.parquet(path)
        return self.workspace.spark.read.schema(df.schema).parquet(path)

    def had(self, table: str) -> dict | None:
        return self.last["tables"].get(table) if self.last else None

    def whole(self, table: str, df: DataFrame, on: list[str], rows: int) -> DataFrame:
        """Write a table anew, in buckets for about as many rows."""
        n = min(MOST_BUCKETS, max(1, -(-rows // self.workspace.bucket_rows)))
        self.tables[table] = {"on": on, "n": n, "ddl": _ddl(df), "parts": {}}
        return self._put(table, df, set(range(n)))

    def change(self, table: str, gone: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
        """Take out the rows with the keys ``gone`` in the columns ``by``, and put in new ones.

        ``by`` has the columns that buckets go by. Only buckets of such keys are read and written. A row
        of ``new`` isn't replaced by another; its key is in ``gone`` if it may be there already.
        """
        entry = self.had(table)
        own = {"on": entry["on"], "n": entry["n"], "ddl": entry["ddl"], "parts": dict(entry["parts"])}
        new = self.step(f"{table}_new", new)
        gone = self.step(f"{table}_gone", gone.select(by).distinct())
        bucket = _bucket(own).alias("b")
        touched = {r[0] for r in new.select(bucket).unionByName(gone.select(bucket)).distinct().collect()}
        self.tables[table] = own
        if not touched:
            return self.workspace._opened(own)
        old = self.workspace._files([p for b, p in own["parts"].items() if int(b) in touched], own["ddl"])
        return self._put(table, old.join(gone, by, "left_anti").select(old.columns).unionByName(new.select(old.columns)), touched)

    def _put(self, table: str, rows: DataFrame, buckets: set[int]) -> DataFrame:
        entry, folder = self.tables[table], f"data/{table}/{self.name}"
        rows.withColumn("_b", _bucket(entry)).repartition("_b").write.partitionBy("_b").parquet(f"{self.workspace.path}/{folder}")
        entry["parts"] = {b: p for b, p in entry["parts"].items() if int(b) not in buckets}
        for name in store.children(self.workspace.spark, f"{self.workspace.path}/{folder}"):
            if name.startswith("_b="):
                entry["parts"][name[3:]] = f"{folder}/{name}"
        return self.workspace._opened(entry)

    def segment(self, table: str, new: DataFrame, gone: DataFrame | None, on: list[str], order: list[str]) -> DataFrame:
        """Add rows of new and changed documents as a segment, and marks of those that are changed or gone.

        Without marks the table starts anew. Segments that have become small beside what follows are
        merged, without the rows that hold no more. Rows are sorted by ``order``, so that a range of it is a part of the files.
        """
        space, entry = self.workspace, self.had(table) if gone is not None else None
        own = {"on": on, "ddl": _ddl(new), "segments": list(entry["segments"]) if entry else []}
        own["segments"].append(self._segment(table, "new", Segment(new, gone if entry else None), order))
        sizes = [s["n"] for s in own["segments"]]
        start = segments.tail(sizes)
        if start < len(sizes) - 1:
            some = space.opened_segments(own)[start:]
            merged = Segment(segments.live(some, on), segments.marks(some, on) if start else None)
            own["segments"][start:] = [self._segment(table, "merged", merged, order)]
        self.tables[table] = own
        return space._opened(own)

    def _segment(self, table: str, name: str, made: Segment, order: list[str]) -> dict:
        space, folder = self.workspace, f"data/{table}/{self.name}-{name}"
        made.rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{space.path}/{folder}/rows")
        if made.gone is not None:
            made.gone.distinct().write.parquet(f"{space.path}/{folder}/gone")
        return {"rows": f"{folder}/rows", "gone": f"{folder}/gone" if made.gone is not None else "", "n": space.spark.read.parquet(f"{space.path}/{folder}/rows").count()}

    def publish(self, meta: dict[str, str]) -> str:
        space = self.workspace
        whole = {"id": self.name, "before": self.last["id"] if self.last else None, "tables": self.tables, "meta": meta, "schema": SCHEMA_ID}
        store.write_text(space.spark, f"{space.path}/manifests/{self.name}.json", json.dumps(whole))
        store.replace_text(space.spark, f"{space.path}/CURRENT", json.dumps({"id": self.name, "schema": SCHEMA_ID}), self.name)
        store.delete_folder(space.spark, f"{space.path}/steps/{self.name}")
        return self.name
