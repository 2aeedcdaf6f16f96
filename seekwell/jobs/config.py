"""Projects and contexts as a file: what is indexed, what is searched, and what is said about it."""

from __future__ import annotations

import json
import os
import time
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from seekwell.functions.names import EngineError, canonical_project

VERSION = 1


@dataclass(frozen=True)
class Project:
    name: str
    root: str
    include: tuple[str, ...] = ("**/*",)
    exclude: tuple[str, ...] = ()
    default_search: bool = True
    ignore_files: bool = True


@dataclass(frozen=True)
class Context:
    """A text about a path and what is below it, of one project or of all."""

    project: str | None
    path: str
    text: str


@dataclass(frozen=True)
class Config:
    projects: tuple[Project, ...] = ()
    contexts: tuple[Context, ...] = ()
    version: int = field(default=VERSION)

    def __post_init__(self) -> None:
        names = [p.name for p in self.projects]
        if len(set(names)) < len(names):
            raise EngineError("INVALID_REQUEST", "two projects have one name")
        if any(c.project is not None and c.project not in names for c in self.contexts):
            raise EngineError("INVALID_REQUEST", "a context names a project that there isn't")
        if self.version != VERSION:
            raise EngineError("INVALID_REQUEST", f"a configuration of version {self.version}")

    def project(self, name: str) -> Project:
        for p in self.projects:
            if p.name == canonical_project(name):
                return p
        raise EngineError("NOT_FOUND", f"no project {name!r}")

    def default_scope(self) -> list[str]:
        return [p.name for p in self.projects if p.default_search]

    def scope(self, wanted: list[str] | None = None) -> list[str]:
        """Projects to search: the named ones, once each in their order, or the default ones."""
        return self.default_scope() if wanted is None else list(dict.fromkeys(self.project(w).name for w in wanted))

    def locate(self, path: str) -> tuple[str, str] | None:
        """Project and path of a file: the first project whose folder has it."""
        full = os.path.normpath(os.path.abspath(path))
        for p in self.projects:
            root = os.path.normpath(p.root)
            if full == root or full.startswith(root.rstrip("/") + "/"):
                return p.name, os.path.relpath(full, root)
        return None

    # --- changes; each gives a new configuration

    def with_project(self, project: Project) -> Config:
        return replace(self, projects=(*self.projects, project))

    def with_default_search(self, names: list[str], default: bool) -> Config:
        chosen = self.scope(names)
        return replace(self, projects=tuple(replace(p, default_search=default) if p.name in chosen else p for p in self.projects))

    def without_project(self, name: str) -> Config:
        gone = self.project(name).name
        return Config(tuple(p for p in self.projects if p.name != gone), tuple(c for c in self.contexts if c.project != gone))

    def renamed(self, old: str, new: str) -> Config:
        was, now = self.project(old).name, canonical_project(new)
        return Config(
            tuple(replace(p, name=now) if p.name == was else p for p in self.projects),
            tuple(replace(c, project=now) if c.project == was else c for c in self.contexts),
        )

    def with_context(self, context: Context) -> Config:
        """The context in place of one for the same project and path, which keeps its place."""
        key = (context.project, context.path)
        by_key = {(c.project, c.path): c for c in self.contexts} | {key: context}
        return replace(self, contexts=tuple(by_key.values()))

    def without_context(self, project: str | None, path: str) -> Config:
        rest = tuple(c for c in self.contexts if (c.project, c.path) != (project, path))
        if len(rest) == len(self.contexts):
            raise EngineError("NOT_FOUND", f"no context for {path!r}")
        return replace(self, contexts=rest)

    # --- as tables

    def project_rows(self, spark: SparkSession) -> DataFrame:
        rows = [(i, p.name, p.root, list(p.include), list(p.exclude), p.default_search, p.ignore_files) for i, p in enumerate(self.projects)]
        schema = "position int, project_name string, root string, include array<string>, exclude array<string>, default_search boolean, ignore_files boolean"
        return spark.createDataFrame(rows, schema)

    def context_rows(self, spark: SparkSession) -> DataFrame:
        rows = [(c.project, c.path, c.text, i) for i, c in enumerate(self.contexts)]
        return spark.createDataFrame(rows, "project string, path string, text string, position int")


def _parsed(text: str) -> object:
    try:
        import yaml
    except ModuleNotFoundError:  # JSON is the part of YAML that needs no library
        return json.loads(text) if text.strip() else None
    return yaml.safe_load(text)


def load(path: str) -> Config:
    """A missing or empty file is an empty configuration; of contexts of one identity the last holds."""
    if not os.path.exists(path):
        return Config()
    with open(path, encoding="utf-8") as f:
        try:
            found = _parsed(f.read())
        except Exception as e:
            raise EngineError("INVALID_CONFIG", f"{path}: {e}") from None
    if found is None:
        return Config()
    try:
        projects = [
            Project(
                canonical_project(p["name"]),
                os.path.abspath(os.path.join(os.path.dirname(path), os.path.expanduser(p["root"]))),
                tuple(p.get("include") or ("**/*",)),
                tuple(p.get("exclude") or ()),
                bool(p.get("default-search", True)),
                bool(p.get("ignore-files", True)),
            )
            for p in found.get("projects") or []
        ]
        out = Config(tuple(projects), (), found.get("version", VERSION))
        for c in found.get("context") or []:
            name = c.get("project")
            out = out.with_context(Context(None if name is None else canonical_project(name), c["path"], c["text"]))
    except (KeyError, TypeError, AttributeError) as e:
        raise EngineError("INVALID_CONFIG", f"{path}: {e!r}") from None
    return out


def save(config: Config, path: str) -> None:
    """Replace the file in one step."""
    projects = [{k.replace("_", "-"): list(v) if isinstance(v, tuple) else v for k, v in asdict(p).items()} for p in config.projects]
    found = {"version": config.version, "projects": projects, "context": [asdict(c) for c in config.contexts]}
    temp = f"{path}.{os.getpid()}.new"
    with open(temp, "w", encoding="utf-8") as f:
        json.dump(found, f, ensure_ascii=False, indent=2)
    os.replace(temp, path)


def load_for_change(path: str) -> Config:
    """Like ``load``, but a file that can't be read is put aside, and the change starts from nothing."""
    try:
        return load(path)
    except EngineError as e:
        if e.code != "INVALID_CONFIG":
            raise
        os.replace(path, f"{path}.invalid-{time.time_ns()}")
        return Config()
