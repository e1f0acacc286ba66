"""Versioned tables as snapshot folders with a commit log, through Hadoop's file system.

table/data/<version>-<id>/ holds the files that a commit added, table/log/<version>.json
names the folders that make up the version. A log entry is created without
overwriting, so of two writers of one version just one succeeds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.functions.columns import all_same
from millrace.operators.warehouse import merge_upsert


#: Name of the column that deals rows to buckets; it is no column of the table.
BUCKET = "__bucket"


def _bucket(keys: Sequence[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int").alias(BUCKET)


@dataclass
class SnapshotTable:
    spark: SparkSession
    path: str

    def _fs(self, at: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, path = self._fs(f"{self.path}/log")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def entry(self, version: int) -> dict:
        fs, path = self._fs(f"{self.path}/log/{version:020d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def history(self) -> list[dict]:
        return [self.entry(v) for v in self.versions()]

    def _commit(self, operation: str, folders: list[str], at: str, based_on: int, note: Mapping[str, object] | None = None) -> int:
        """note: what else the log says of this version; buckets stay from version to version while their folders do."""
        version = based_on + 1
        entry = {"version": version, "operation": operation, "at": at, "folders": folders, **(note or {})}
        fs, path = self._fs(f"{self.path}/log/{version:020d}.json")
        stream = fs.create(path, False)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        return version

    def _write(self, df: DataFrame, version: int, partition: Sequence[str]) -> str:
        folder = f"data/{version:020d}-{uuid.uuid4().hex}"
        writer = df.write.mode("error")
        (writer.partitionBy(*partition) if partition else writer).parquet(f"{self.path}/{folder}")
        return folder

    def _latest(self) -> tuple[int, list[str]]:
        versions = self.versions()
        return (versions[-1], self.entry(versions[-1])["folders"]) if versions else (0, [])

    def append(self, df: DataFrame, at: str, partition: Sequence[str] = (), note: Mapping[str, object] | None = None) -> int:
        version, folders = self._latest()
        return self._commit("append", [*folders, self._write(df, version + 1, partition)], at, version, self._buckets() | dict(note or {}))

    def overwrite(self, df: DataFrame, at: str, partition: Sequence[str] = (), note: Mapping[str, object] | None = None, buckets: tuple[Sequence[str], int] | None = None) -> int:
        """The rows as a new version. buckets: (keys, number) deals them to folders by their keys, so that later changes by these keys rewrite only the folders they hit."""
        version, _ = self._latest()
        if buckets is None:
            return self._commit("overwrite", [self._write(df, version + 1, partition)], at, version, note)
        said = {"buckets": {"keys": list(buckets[0]), "n": buckets[1]}}
        return self._commit("overwrite", self._write_buckets(df, version + 1, **said["buckets"]), at, version, said | dict(note or {}))

    def _buckets(self) -> dict:
        """What the last version says of its buckets."""
        versions = self.versions()
        found = self.entry(versions[-1]).get("buckets") if versions else None
        return {"buckets": found} if found else {}

    def _write_buckets(self, df: DataFrame, version: int, keys: Sequence[str], n: int) -> list[str]:
        """Folders of the buckets that ``df`` has rows in."""
        dealt = df.withColumn(BUCKET, _bucket(keys, n)).repartition(BUCKET)
        folder = self._write(dealt, version, [BUCKET])
        fs, path = self._fs(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        return [f"{folder}/{n}" for n in sorted(names) if n.startswith(f"{BUCKET}=")]

    def rewrite(self, changes: DataFrame, keys: Sequence[str], make: Callable[[DataFrame | None], DataFrame], operation: str, at: str, note: Mapping[str, object] | None = None) -> int:
        """A new version in which ``make`` gives the rows of the folders that hold keys of ``changes``; all other folders stay as they are.

        make: from the rows of those folders (None: there are none) to their new rows; it must leave alone rows whose keys ``changes`` does not hold.
        With buckets by these keys, only the buckets of the changes' keys are read at all.
        """
        version, folders = self._latest()
        said = self._buckets()
        own = said.get("buckets")
        asked = changes.select(*keys).distinct()
        hit = folders
        if own and list(own["keys"]) == list(keys):
            numbers = {r[0] for r in asked.select(_bucket(keys, own["n"])).distinct().collect()}  # at most n of them
            hit = [f for f in folders if f"/{BUCKET}=" not in f or int(f.rpartition("=")[2]) in numbers]
        if hit:
            tagged = None
            for i, f in enumerate(hit):
                part = self.spark.read.parquet(f"{self.path}/{f}").select(*keys, F.lit(i).alias("__folder"))
                tagged = part if tagged is None else tagged.union(part)
            met = tagged.alias("t").join(asked.alias("a"), all_same("t", "a", keys), "left_semi")
            held = {r[0] for r in met.select("__folder").distinct().collect()}  # folders, not rows
            hit = [f for i, f in enumerate(hit) if i in held or own and f"/{BUCKET}=" in f]
        new = make(self._union(hit) if hit else None)
        kept = [f for f in folders if f not in hit]
        written = self._write_buckets(new, version + 1, **own) if own else [self._write(new, version + 1, ())]
        return self._commit(operation, [*kept, *written], at, version, said | dict(note or {}))

    def merge(self, source: DataFrame, keys: Sequence[str], values: Sequence[str], at: str) -> int:
        """Upsert by keys as a new version; folders without a key of the source are kept."""
        fresh = source.select(*keys, *values)
        return self.rewrite(source, keys, lambda known: fresh if known is None else merge_upsert(known, source, keys, values), "merge", at)

    def delete(self, condition: str, at: str) -> int:
        """Remove the rows for which the condition is true, as a new version; folders without such a row are kept as they are."""
        version, folders = self._latest()
        kept = []
        for folder in folders:
            own = self.spark.read.parquet(f"{self.path}/{folder}")
            if own.where(condition).isEmpty():
                kept.append(folder)
            else:
                kept.append(self._write(own.where(~F.coalesce(F.expr(condition), F.lit(False))), version + 1, ()))
        return self._commit("delete", kept, at, version, self._buckets())

    def compact(self, at: str, partition: Sequence[str] = ()) -> int:
        """The same rows in one folder, as a new version; adaptive execution gives its files an even size."""
        version, _ = self._latest()
        return self._commit("compact", [self._write(self.scan().hint("rebalance"), version + 1, partition)], at, version)

    def vacuum(self, keep: int) -> list[str]:
        """Forget all but the last ``keep`` versions and delete the folders that only they name; no writer may be at work."""
        if keep < 1:
            raise ValueError("at least one version must stay")
        versions = self.versions()
        named = {v: self.entry(v)["folders"] for v in versions}
        used = {f for v in versions[-keep:] for f in named[v]}
        gone = sorted({f for v in versions[:-keep] for f in named[v]} - used)
        for version in versions[:-keep]:
            fs, path = self._fs(f"{self.path}/log/{version:020d}.json")
            fs.delete(path, False)
        for folder in gone:
            fs, path = self._fs(f"{self.path}/{folder}")
            fs.delete(path, True)
        return gone

    def _union(self, folders: Sequence[str]) -> DataFrame:
        """The rows of folders; buckets written by one commit are one read."""
        groups: dict[str, list[str]] = {}
        for f in folders:
            groups.setdefault(f.rpartition("/")[0] if f"/{BUCKET}=" in f else f, []).append(f"{self.path}/{f}")
        parts = [self.spark.read.parquet(*own) for own in groups.values()]
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p, allowMissingColumns=True)
        return df

    def scan(self, version: int | None = None, as_of: str | None = None, equal: Mapping[str, object] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """The table at a version, or at the last one committed by ``as_of`` (ISO text); filters and columns reach the files."""
        if as_of is not None:
            known = [e["version"] for e in self.history() if e["at"] <= as_of]
            if not known:
                raise ValueError(f"no version by {as_of}")
            version = known[-1]
        entry = self.entry(version if version is not None else self._latest()[0])
        df = self._union(entry["folders"])
        for c, v in (equal or {}).items():
            df = df.where(F.col(c) == F.lit(v))
        return df.select(*columns) if columns else df
