"""Several stored tables that change together: snapshots, each named by one manifest.

A store is a folder: ``data`` has the rows of each table in folders of their own that are never written twice,
``manifests`` a small file for each snapshot with the folders that make up every table then. A commit
writes new rows first and its manifest last, by a rename that fails if another commit has taken the
number. So all its tables change at once or none does, a reader keeps the snapshot that it began with, and a
table may be replaced by what was just read from it. Folders without a manifest, of commits that failed,
are seen by nobody.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from deltadoc.plans.review import upserted, without


class Conflict(RuntimeError):
    """Another commit came first; nothing was changed."""


@dataclass
class Snapshot:
    """A state of the store: ``tables`` has the schema (JSON) and the folders of each."""

    spark: SparkSession
    root: str
    number: int
    tables: dict[str, dict]

    def read(self, table: str) -> DataFrame:
        """A table's rows; KeyError for one that the snapshot doesn't have."""
        its = self.tables[table]
        schema = StructType.fromJson(its["schema"])
        if not its["folders"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{f}" for f in its["folders"]])


class Store:
    """Tables below ``root``, a path that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def numbers(self) -> list[int]:
        """Numbers of all snapshots, from 1."""
        folder = self._path(f"{self.root}/manifests")
        names = [f.getPath().getName() for f in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The last snapshot or that of ``number``; an empty one, 0, before the first commit."""
        number = number if number is not None else max(self.numbers(), default=0)
        if number == 0:
            return Snapshot(self.spark, self.root, 0, {})
        stream = self._files.open(self._path(f"{self.root}/manifests/{number:012d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Snapshot(self.spark, self.root, number, json.loads(text))

    def commit(self, base: Snapshot, *, replaced: dict[str, DataFrame] | None = None, appended: dict[str, DataFrame] | None = None) -> Snapshot:
        """The snapshot after ``base`` with tables replaced and rows appended, all at once; Conflict if it isn't the last any more.

        Appended rows get a folder of their own and must have the table's columns; a table is made by either.
        """
        tables = {name: dict(its) for name, its in base.tables.items()}
        for name, rows in (replaced or {}).items():
            tables[name] = {"schema": json.loads(rows.schema.json()), "folders": [self._written(name, rows)]}
        for name, rows in (appended or {}).items():
            its = tables.setdefault(name, {"schema": json.loads(rows.schema.json()), "folders": []})
            columns = [f["name"] for f in its["schema"]["fields"]]
            if sorted(columns) != sorted(rows.columns):
                raise ValueError(f"{name} has the columns {columns}, not {rows.columns}")
            kinds = StructType.fromJson(its["schema"])
            rows = rows.select(*[rows[c].cast(kinds[c].dataType).alias(c) for c in columns])
            tables[name] = its | {"folders": [*its["folders"], self._written(name, rows)]}
        return self._named(base.number + 1, tables)

    def _written(self, name: str, rows: DataFrame) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.root}/data/{folder}")
        return folder

    def _named(self, number: int, tables: dict[str, dict]) -> Snapshot:
        """Makes ``tables`` the snapshot of this number, unless there is one."""
        self._files.mkdirs(self._path(f"{self.root}/manifests"))
        ready, final = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifests/{number:012d}.json")
        out = self._files.create(ready, True)
        try:
            out.write(bytearray(json.dumps(tables).encode()))
        finally:
            out.close()
        if self._files.exists(final):
            self._files.delete(ready, False)
            raise Conflict(f"snapshot {number} exists")
        try:
            self._context.rename(ready, final, self._no_options)
        except Exception as e:  # the file system's own error; only a taken name is a conflict
            self._files.delete(ready, False)
            if self._files.exists(final):
                raise Conflict(f"snapshot {number} exists") from e
            raise
        return Snapshot(self.spark, self.root, number, tables)

    def transact(self, change: Callable[[Snapshot], dict], tries: int = 5) -> Snapshot:
        """Commits what ``change`` makes of the last snapshot (arguments of ``commit``), anew after each conflict."""
        for left in range(tries - 1, -1, -1):
            base = self.snapshot()
            try:
                return self.commit(base, **change(base))
            except Conflict:
                if not left:
                    raise
        raise ValueError("tries must be at least 1")


def review(store: Store, reviews: DataFrame, notes: DataFrame, audit: DataFrame) -> Snapshot:
    """Reviews in place of those of the same change, their notes and what the audit says of them, in one commit."""

    def change(base: Snapshot) -> dict:
        old = base.read("reviews") if "reviews" in base.tables else reviews.limit(0)
        return {"replaced": {"reviews": upserted(old, reviews, ["cmp_id", "change_id"])}, "appended": {"notes": notes, "audit": audit}}

    return store.transact(change)


def delete_comparisons(store: Store, gone: DataFrame, audit: DataFrame) -> Snapshot:
    """Leaves comparisons (cmp_id) out of every table that has them, but the audit, which says that they went."""

    def change(base: Snapshot) -> dict:
        has = [t for t, its in base.tables.items() if t != "audit" and any(f["name"] == "cmp_id" for f in its["schema"]["fields"])]
        return {"replaced": {t: without(base.read(t), gone, ["cmp_id"]) for t in has}, "appended": {"audit": audit}}

    return store.transact(change)
