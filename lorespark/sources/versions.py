"""A store of tables whose changes appear together: a manifest names the tables of each version, and is written last.

``tables/<name>/<id>`` are Parquet tables that never change; ``manifest/<version>`` is a small file with the table of
each name, the generation of each index and the migrations that have run. A commit writes the tables that change and
then the next manifest, which can be created once only, so of two writers that began from the same version one fails.
Readers follow a manifest: they see all of a commit or nothing of it, and a version stays readable until it is
vacuumed. A commit that is broken off leaves tables that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lorespark.operators.index import Index
from lorespark.sources.shared import delete, file_system


class Conflict(RuntimeError):
    """Another writer has made the next version."""


@dataclass(frozen=True)
class Version:
    """What a manifest names; version 0 has nothing."""

    spark: SparkSession
    root: str
    number: int = 0
    tables: dict[str, str] = field(default_factory=dict)
    indexes: dict[str, int] = field(default_factory=dict)
    migrations: tuple[str, ...] = ()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/tables/{self.tables[name]}")

    def index(self, name: str) -> Index:
        """The index as it was when the version was committed."""
        return Index(self.spark, f"{self.root}/indexes/{name}", self.indexes.get(name, 0))

    def commit(self, changes: dict[str, DataFrame], indexes: dict[str, Callable[[Index], None]] | None = None, migrations: Iterable[str] = ()) -> Version:
        """The next version: tables that are replaced, and what is done to indexes, all of which appear at once. Raises :class:`Conflict`."""
        found = dict(self.tables)
        for name, df in changes.items():
            found[name] = f"{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/tables/{found[name]}")
        generations = dict(self.indexes)
        for name, change in (indexes or {}).items():
            # what an earlier commit left that was broken off is no part of this version
            at = Index(self.spark, f"{self.root}/indexes/{name}", keep=True)
            at.forget_after(generations.get(name, 0))
            change(at)
            generations[name] = max(at.generations(), default=0)
        after = Version(self.spark, self.root, self.number + 1, found, generations, (*self.migrations, *migrations))
        after._create()
        return after

    def _create(self) -> None:
        """The manifest, whole or not at all: written aside, then moved to a name that mustn't be there."""
        text = json.dumps({"tables": self.tables, "indexes": self.indexes, "migrations": self.migrations})
        aside = f"{self.root}/manifest/.{uuid.uuid4().hex}"
        fs, at = file_system(self.spark, aside)
        out = fs.create(at, False)
        out.write(bytearray(text.encode()))
        out.close()
        _, final = file_system(self.spark, _name(self.root, self.number))
        if fs.exists(final) or not fs.rename(at, final):
            fs.delete(at, False)
            raise Conflict(f"version {self.number} is there already")

    def migrate(self, steps: list[tuple[str, Callable[[Version], dict[str, DataFrame]]]]) -> Version:
        """Runs the steps that haven't run, in their order, each as a version of its own that records it."""
        now = self
        for name, step in steps:
            if name not in now.migrations:
                now = now.commit(step(now), migrations=[name])
        return now


def _name(root: str, number: int) -> str:
    return f"{root}/manifest/{number:012d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, at = file_system(spark, f"{root}/manifest")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def open_version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """A version of the store, the latest one unless ``number`` is given; version 0 of a store that isn't there."""
    if number is None:
        number = max(versions(spark, root), default=0)
    if number == 0:
        return Version(spark, root)
    j = json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(_name(root, number)).collect()))  # a file of some names
    return Version(spark, root, number, j["tables"], j["indexes"], tuple(j["migrations"]))


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Deletes all but the newest ``keep`` versions, and tables that no other one names; nobody may be committing meanwhile."""
    found = versions(spark, root)
    kept = [open_version(spark, root, n) for n in found[-keep:]]
    for n in found[:-keep]:
        delete(spark, _name(root, n))
    named = {t for v in kept for t in v.tables.values()}
    fs, at = file_system(spark, f"{root}/tables")
    if fs.exists(at):
        for table in fs.listStatus(at):
            for one in fs.listStatus(table.getPath()):
                if f"{table.getPath().getName()}/{one.getPath().getName()}" not in named:
                    fs.delete(one.getPath(), True)
    for name in {i for v in kept for i in v.indexes}:
        Index(spark, f"{root}/indexes/{name}", keep=True).clear(min(v.indexes.get(name, 0) for v in kept))
