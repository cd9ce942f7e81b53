"""Tables in versions: a base in buckets, and what each version since has changed.

A store is a folder.  Each of its tables has a key, which may have several rows, and is written once as a base, dealt
into buckets by the columns that it is looked up by.  A commit adds, for each table that changes, the keys that are no
longer as they were and the rows that they have now; nothing that is there is rewritten.  A version's manifest is
written last, so a commit that breaks off leaves the store as it was, and one that is tried again replaces its own
leavings.  Of two commits of the same version the second fails.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.plans.storage import materialize, open_buckets, write_buckets

VERSION = "version"


@dataclass
class Layered:
    """A table at one version: base rows whose keys are not dead, and the live rows of later versions."""

    keys: list[str]
    base: DataFrame
    live: DataFrame | None = None
    dead: DataFrame | None = None

    def whole(self) -> DataFrame:
        if self.live is None:
            return self.base
        return self.base.join(self.dead, self.keys, "left_anti").unionByName(self.live)

    def meet(self, rows: DataFrame, on: list[str]) -> DataFrame:
        """rows joined with the table on columns that both have, the key's among them.

        The base stays in its buckets if they are by `on`; rows of dead keys meet the later rows alone.  Where there
        are such, rows are written down first, as they are read for either part.
        """
        if self.live is None:
            return rows.join(self.base, on)
        rows = materialize(rows, "asked")
        return rows.join(self.dead, self.keys, "left_anti").join(self.base, on).unionByName(rows.join(self.live, on))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


class Store:
    """One version of a store: facts are what its manifest says besides."""

    def __init__(self, spark: SparkSession, folder: str, manifest: dict):
        self.spark, self.folder, self.manifest = spark, folder, manifest
        self.version, self.facts = manifest["version"], manifest["facts"]
        self._opened: dict[str, Layered] = {}

    @classmethod
    def create(cls, spark: SparkSession, folder: str, tables: dict[str, tuple[DataFrame, list[str], list[str]]], facts: dict | None = None) -> Store:
        """A new store of tables, each (rows, key columns, columns that it is looked up by)."""
        return cls._based(spark, folder, 0, tables, facts or {})

    @classmethod
    def _based(cls, spark: SparkSession, folder: str, version: int, tables: dict, facts: dict) -> Store:
        known = {}
        for name, (rows, keys, at) in tables.items():
            path = f"{folder}/{name}/base-{version}"
            known[name] = {"keys": keys, "at": at, "schema": _ddl(rows), "base": path, "buckets": write_buckets(rows, at, path), "changes": []}
        return cls._committed(spark, folder, {"version": version, "facts": facts, "tables": known})

    @classmethod
    def _committed(cls, spark: SparkSession, folder: str, manifest: dict) -> Store:
        line = spark.createDataFrame([(json.dumps(manifest),)], "value string")
        line.coalesce(1).write.mode("error").text(f"{folder}/manifests/{VERSION}={manifest['version']}")
        return cls(spark, folder, manifest)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, version: int | None = None) -> Store:
        """A version of the store at folder, by default the last one."""
        found = spark.read.text(f"{folder}/manifests")
        if version is not None:
            found = found.filter(F.col(VERSION) == version)
        last = found.orderBy(F.desc(VERSION)).first()
        if last is None:
            raise ValueError(f"{folder} has no version {version}")
        return cls(spark, folder, json.loads(last.value))

    def table(self, name: str) -> Layered:
        if name not in self._opened:
            about = self.manifest["tables"][name]
            base = open_buckets(self.spark, about["base"], about["schema"], about["at"], about["buckets"])
            self._opened[name] = Layered(about["keys"], base, *self._changes(name, about))
        return self._opened[name]

    def _changes(self, name: str, about: dict) -> tuple[DataFrame | None, DataFrame | None]:
        if not about["changes"]:
            return None, None
        read = lambda part, schema: (
            self.spark.read.schema(f"{schema}, {VERSION} long").option("basePath", f"{self.folder}/{name}/{part}")
            .parquet(*[f"{self.folder}/{name}/{part}/{VERSION}={v}" for v in about["changes"]])
        )
        keys, fields = about["keys"], {f.name: f.dataType.simpleString() for f in self.spark.createDataFrame([], about["schema"]).schema.fields}
        rows, dead = read("rows", about["schema"]), read("dead", ", ".join(f"`{k}` {fields[k]}" for k in keys))
        if len(about["changes"]) > 1:
            # the last change of a key counts
            last = dead.groupBy(*keys).agg(F.max(VERSION).alias(VERSION))
            rows = rows.join(last, [*keys, VERSION], "left_semi")
        return rows.drop(VERSION), dead.select(*keys).distinct()

    def commit(self, changes: dict[str, tuple[DataFrame, DataFrame]], facts: dict | None = None) -> Store:
        """The next version: of each changed table (keys that change, the rows that they have from now on)."""
        version, tables = self.version + 1, {k: dict(v) for k, v in self.manifest["tables"].items()}
        for name, (dead, rows) in changes.items():
            about, fields = tables[name], self.table(name).base.columns
            dead.select(*about["keys"]).distinct().write.mode("overwrite").parquet(f"{self.folder}/{name}/dead/{VERSION}={version}")
            rows.select(*fields).write.mode("overwrite").parquet(f"{self.folder}/{name}/rows/{VERSION}={version}")
            about["changes"] = [*about["changes"], version]
        return self._committed(self.spark, self.folder, {"version": version, "facts": self.facts | (facts or {}), "tables": tables})

    def rebased(self, tables: dict[str, tuple[DataFrame, list[str], list[str]]], facts: dict | None = None) -> Store:
        """The next version, whose tables are bases written anew."""
        return self._based(self.spark, self.folder, self.version + 1, tables, self.facts | (facts or {}))
