"""A library of tables as numbered versions in a shared folder.

A commit writes its rows as new Parquet files first, and then one manifest that names them, renamed into place under the
next version's number.  Readers take the files that manifests name, so they see all of a commit or nothing: what a
killed job has left is never read.  Nothing is changed in place; the latest value of each field counts, deleted keys
are rows that say so, and compact() writes what counts as one new base.

The folder must be on a file system whose rename is atomic and refuses a name that exists.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

#: the keys of each kind of row, and what its rows hang on: kind -> (keys, kind of the parent, the parent's key)
KINDS: dict[str, tuple[list[str], str | None, str | None]] = {
    "documents": (["document_id"], None, None), "tables": (["table_id"], "documents", "document_id"), "runs": (["run_id"], "tables", "table_id"),
    "cells": (["run_id", "row", "col"], "runs", "run_id"), "rows": (["run_id", "row"], "runs", "run_id"), "columns": (["table_id", "col"], "tables", "table_id"),
    "corrections": (["correction_id"], "tables", "table_id"), "checks": (["run_id", "kind", "check_id"], "runs", "run_id"), "recipes": (["recipe_id", "version"], None, None),
}
#: rows of these stay as they were first written
INSERT_ONLY = {"corrections"}
_OWN = [StructField("__version", LongType()), StructField("__deleted", BooleanType())]


class Conflict(RuntimeError):
    """Another commit has taken the version: read the store again and build the commit anew."""


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _manifests(self, at: int | None = None) -> list[dict]:
        """What each version names, in order; a row for each commit since the store began."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return []
        found = [json.loads(r["value"]) for r in self.spark.read.option("recursiveFileLookup", True).text(f"{self.root}/manifests").collect()]
        return sorted((m for m in found if at is None or m["version"] <= at), key=lambda m: m["version"])

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        return max((m["version"] for m in self._manifests()), default=0)

    def commit(self, rows: dict[str, DataFrame] | None = None, deleted: dict[str, DataFrame] | None = None, base: int | None = None, whole: bool = False) -> int:
        """Writes rows by kind, and takes the keys in deleted away, as the version after base (the last one); its number.

        Of a row only the fields that its DataFrame has are set, the others keep their values: an update of two columns
        touches these.  A kind has a key at most once in a commit; a row and a deletion of one key leave the row.  Where
        base is not the last version any more, nothing is changed and Conflict is raised.  whole: the rows are all that
        there is of their kinds.
        """
        base = self.version() if base is None else base
        rows, deleted = rows or {}, deleted or {}
        named = {}
        for kind in sorted({*rows, *deleted}):
            keys = KINDS[kind][0]
            parts = []
            if kind in rows:
                parts.append(rows[kind].withColumn("__deleted", F.lit(False)))
            if kind in deleted:
                parts.append(deleted[kind].select(*keys).distinct().withColumn("__deleted", F.lit(True)))
            data = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
            path = f"data/{kind}/{uuid.uuid4().hex}"
            data.withColumn("__version", F.lit(base + 1).cast("long")).write.parquet(f"{self.root}/{path}")
            own = StructType([f for f in data.schema.fields if not f.name.startswith("__")])
            named[kind] = {"path": path, "schema": own.jsonValue(), "whole": whole, "deletes": kind in deleted}
        self._publish({"version": base + 1, "kinds": named})
        return base + 1

    def _publish(self, manifest: dict) -> None:
        """The second phase: the manifest is written beside and renamed into place, which fails where the name is taken."""
        tmp, to = f"{self.root}/manifests/_{uuid.uuid4().hex}", f"{self.root}/manifests/{manifest['version']:012d}"
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(tmp)
        jvm = self.spark._jvm
        path, conf = jvm.org.apache.hadoop.fs.Path, self.spark._jsc.hadoopConfiguration()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(to).toUri(), conf)
        kept = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        taken = files.util().exists(path(to))
        if not taken:
            try:
                files.rename(path(tmp), path(to), kept)
                return
            except Exception as e:  # noqa: BLE001
                if "FileAlreadyExists" not in str(e):
                    raise
        files.delete(path(tmp), True)
        raise Conflict(f"version {manifest['version']} is taken")

    def _parts(self, kind: str, at: int | None = None) -> list[dict]:
        """What versions name of a kind, from its last base on: version, path, fields by name, and whether keys may be deleted."""
        own = [m["kinds"][kind] | {"version": m["version"]} for m in self._manifests(at) if kind in m["kinds"]]
        last = max((i for i, p in enumerate(own) if p["whole"]), default=0)
        read = lambda p: {f.name: f.dataType for f in StructType.fromJson(p["schema"]).fields}
        return [{"version": p["version"], "path": p["path"], "fields": read(p), "deletes": p.get("deletes", True)} for p in own[last:]]

    def _rows(self, kind: str, parts: list[dict]) -> DataFrame | None:
        """The rows of parts in one scan, whatever their number, with __version and __deleted: fields that a commit did not know are null."""
        fields: dict[str, StructField] = {}
        for p in parts:
            for name, of in p["fields"].items():
                if name in fields and fields[name].dataType != of:
                    raise PySparkException(f"{kind}.{name} is {fields[name].dataType.simpleString()} and {of.simpleString()}")
                fields.setdefault(name, StructField(name, of, True))
        if not fields:
            return None
        return self.spark.read.schema(StructType([*fields.values(), *_OWN])).parquet(*[f"{self.root}/{p['path']}" for p in parts])

    def history(self, kind: str, at: int | None = None) -> DataFrame | None:
        """Every row that was written of a kind up to a version, with __version, __deleted and __set, the fields it sets; None if there is none."""
        parts = self._parts(kind, at)
        d = self._rows(kind, parts)
        if d is None:
            return None
        sets = [x for p in parts for x in (F.lit(p["version"]).cast("long"), F.array(*[F.lit(c) for c in p["fields"] if c not in KINDS[kind][0]]).cast("array<string>"))]
        return d.withColumn("__set", F.when(~F.col("__deleted"), F.element_at(F.create_map(*sets), F.col("__version"))))

    def current(self, kind: str, at: int | None = None, schema: str | None = None, of: DataFrame | None = None) -> DataFrame | None:
        """The rows of a kind as they are, or were at a version: keys and fields.  None, or an empty table of schema, if there is none.

        of: some keys of the kind, each once for what else it has.  Only rows with these keys are put together, and its other columns come
        along, instead of fields of their names.
        """
        parts = self._parts(kind, at)
        d = self._rows(kind, parts)
        if d is None and schema is None:
            return None
        keys = KINDS[kind][0]
        more = [] if of is None else [c for c in of.columns if c not in keys]
        some = lambda x: x if of is None else x.drop(*more).join(of.hint("shuffle_hash"), [c for c in of.columns if c in keys])
        if d is None:
            return some(self.spark.createDataFrame([], schema))
        d = some(d)
        fields = [c for c in d.columns if c not in keys and c not in more and not c.startswith("__")]
        live = ~F.col("__deleted")
        if len(parts) == 1:  # a key is in a commit at most once, and its row outlasts its deletion
            return d.filter(live).select(*keys, *more, *fields)
        pick = F.min_by if kind in INSERT_ONLY else F.max_by
        v = F.col("__version")

        def found(c: str) -> Column:
            setting = [p["version"] for p in parts if c in p["fields"]]
            ok = live if len(setting) == len(parts) else live & v.isin(setting)
            return pick(F.struct(v.alias("v"), F.col(c).alias("x")), F.when(ok, v)).alias(f"__x_{c}")

        each = [found(c) for c in fields]
        if not any(p["deletes"] for p in parts):
            values = [F.col(f"__x_{c}")["x"].alias(c) for c in fields]
            return (d.groupBy(*keys, *more).agg(*each) if each else d.select(*keys, *more).distinct()).select(*keys, *more, *values)
        edges = [F.max(F.when(F.col("__deleted"), v)).alias("__gone"), F.max(F.when(live, v)).alias("__born")]
        gone = F.coalesce("__gone", F.lit(-1))
        values = [F.when(F.col(f"__x_{c}")["v"] >= gone, F.col(f"__x_{c}")["x"]).alias(c) for c in fields]
        return d.groupBy(*keys, *more).agg(*edges, *each).filter(F.col("__born") >= gone).select(*keys, *more, *values)

    def hanging_on(self, kind: str, keys: DataFrame) -> dict[str, DataFrame]:
        """The keys to delete with those of a kind: of the kind itself and of all that hangs on it, level by level."""
        gone = {kind: keys.select(*KINDS[kind][0]).distinct()}
        for child, (own, parent, key) in KINDS.items():  # parents come first
            if parent in gone:
                held = gone[parent].select(key).distinct()
                d = self.current(child, of=held if key in own else None)
                if d is not None:
                    gone[child] = (d if key in own else d.join(held, key, "left_semi")).select(*own)
        return gone

    def delete(self, kind: str, keys: DataFrame, base: int | None = None) -> int:
        """Deletes keys of a kind and all that hangs on them, in one commit."""
        base = self.version() if base is None else base
        return self.commit(deleted=self.hanging_on(kind, keys), base=base)

    def compact(self, *kinds: str) -> int:
        """What counts of these kinds as one new base: later reads leave out what was written before."""
        base = self.version()
        return self.commit({k: d for k in kinds if (d := self.current(k)) is not None}, base=base, whole=True)

    def left_behind(self) -> list[str]:
        """Folders of rows that no manifest names: of commits that failed, or are still being written."""
        jvm, named = self.spark._jvm, {p["path"] for m in self._manifests() for p in m["kinds"].values()}
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/data")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        folders = [f"data/{k.getPath().getName()}/{b.getPath().getName()}" for k in fs.listStatus(at) for b in fs.listStatus(k.getPath())] if fs.exists(at) else []
        return sorted(f for f in folders if f not in named)
