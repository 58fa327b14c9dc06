"""Versioned datasets: immutable version folders, and a manifest that moves by compare-and-swap.

A dataset is ``root/<id>/``: ``data/<version>/<table>/`` holds Parquet tables, ``manifests/<n>.json`` says which
version is current after the n-th publication, and ``snapshots/<id>.json`` names kept versions. Publication
creates the next manifest with the exclusive flag of the file system, so of two writers one loses. All access
goes through Hadoop's file system; object stores whose creation is a check and a put, so not exclusive, are refused.
Only the last ``KEPT`` manifests stay, so finding the current one lists few names.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "quillon-1"
KEPT = 64
#: File systems whose create() without overwriting is exclusive.
EXCLUSIVE = {"file", "hdfs", "viewfs", "webhdfs", "ofs"}


class Superseded(Exception):
    """Another writer published first."""


class Absent(Exception):
    """There is no such dataset, version or snapshot; an empty one is not absent."""


class Refused(Exception):
    """The operation would lose or mix data."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self._fs.getUri().getScheme() not in EXCLUSIVE:
            raise Refused(f"{self._fs.getUri()} has no exclusive creation")

    def _at(self, *parts: str):
        return self._path("/".join((self.root, *parts)))

    def _names(self, *parts: str) -> list[str]:
        at = self._at(*parts)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _read(self, *parts: str) -> dict:
        at = self._at(*parts)
        if not self._fs.exists(at):
            raise Absent("/".join(parts))
        stream = self._fs.open(at)
        try:
            found = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        if found.get("format") != FORMAT:
            raise Refused(f"unknown format {found.get('format')!r}")
        return found

    def _create(self, content: dict, *parts: str) -> None:
        """Write a file that must not exist yet."""
        at = self._at(*parts)
        try:
            stream = self._fs.create(at, False)
        except Exception as e:
            if self._fs.exists(at):
                raise Superseded("/".join(parts)) from e
            raise
        stream.write(json.dumps({"format": FORMAT} | content).encode())
        stream.close()

    def exists(self, dataset: str) -> bool:
        return bool(self._names(dataset, "manifests"))

    def etag(self, dataset: str) -> int:
        """Number of the current manifest; 0 before the first."""
        return max((int(n.removesuffix(".json")) for n in self._names(dataset, "manifests") if n.endswith(".json")), default=0)

    def current(self, dataset: str) -> dict:
        n = self.etag(dataset)
        if not n:
            raise Absent(dataset)
        return self._read(dataset, "manifests", f"{n:012d}.json") | {"etag": n}

    def tables(self, dataset: str, version: str | None = None) -> dict[str, DataFrame]:
        version = version or self.current(dataset)["version"]
        names = self._names(dataset, "data", version)
        if not names and not self._fs.exists(self._at(dataset, "data", version)):
            raise Absent(f"{dataset} {version}")
        return {t: self.spark.read.parquet(f"{self.root}/{dataset}/data/{version}/{t}") for t in names}

    def read_if_changed(self, dataset: str, etag: int) -> tuple[int, dict[str, DataFrame]] | None:
        """The tables, unless the manifest is still the one known."""
        now = self.etag(dataset)
        return None if now == etag else (now, self.tables(dataset))

    def publish(self, dataset: str, tables: Mapping[str, DataFrame], schema_version: int, expected: int | None = None) -> int:
        """Write a new version and make it current; Superseded if the manifest is no longer ``expected``."""
        before = self.etag(dataset) if expected is None else expected
        version = uuid.uuid4().hex
        self._fs.mkdirs(self._at(dataset, "data", version))
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{dataset}/data/{version}/{name}")
        return self._point(dataset, version, schema_version, before)

    def _point(self, dataset: str, version: str, schema_version: int, before: int) -> int:
        if self.etag(dataset) != before:
            raise Superseded(dataset)
        self._create({"version": version, "schema_version": schema_version, "at": datetime.now(UTC).isoformat()}, dataset, "manifests", f"{before + 1:012d}.json")
        if before >= KEPT:
            self._fs.delete(self._at(dataset, "manifests", f"{before + 1 - KEPT:012d}.json"), False)
        return before + 1

    def snapshot(self, dataset: str, label: str | None = None) -> str:
        """Keep the current version under an id ``<UTC stamp>-<unique>[-label]``."""
        now = self.current(dataset)
        if label is not None and not re.fullmatch("[a-z0-9]+", label):
            raise Refused(f"label {label!r}")
        name = datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ") + "-" + uuid.uuid4().hex[:8] + (f"-{label}" if label else "")
        self._create({"version": now["version"], "schema_version": now["schema_version"]}, dataset, "snapshots", f"{name}.json")
        return name

    def snapshots(self, dataset: str) -> list[str]:
        """Newest first."""
        return sorted((n.removesuffix(".json") for n in self._names(dataset, "snapshots") if n.endswith(".json")), reverse=True)

    def read_snapshot(self, dataset: str, snapshot: str) -> dict[str, DataFrame]:
        return self.tables(dataset, self._read(dataset, "snapshots", f"{snapshot}.json")["version"])

    def restore(self, dataset: str, snapshot: str, *, force: bool = False) -> int:
        """Make a snapshot current; one of another schema version only if forced."""
        kept, now = self._read(dataset, "snapshots", f"{snapshot}.json"), self.current(dataset)
        if kept["schema_version"] != now["schema_version"] and not force:
            raise Refused(f"schema {kept['schema_version']} is not {now['schema_version']}")
        return self._point(dataset, kept["version"], kept["schema_version"], now["etag"])

    def revert(self, dataset: str, version: str, schema_version: int, *, written_after: bool, force: bool = False) -> int:
        """Go back to a version; refused if rows were written since it was left, unless forced."""
        if written_after and not force:
            raise Refused("rows were written since")
        self.tables(dataset, version)
        return self._point(dataset, version, schema_version, self.etag(dataset))

    def fork(self, source: str, target: str) -> int:
        """A new dataset with the source's current tables."""
        now = self.current(source)
        if self.exists(target):
            raise Refused(f"{target} exists")
        return self.publish(target, self.tables(source), now["schema_version"], 0)

    def purge(self, dataset: str) -> bool:
        """Delete a dataset by its exact name."""
        if not dataset or "/" in dataset:
            raise Refused(dataset)
        return self._fs.delete(self._at(dataset), True)

    def drop_version(self, dataset: str, version: str) -> bool:
        if self.current(dataset)["version"] == version or any(self._read(dataset, "snapshots", f"{s}.json")["version"] == version for s in self.snapshots(dataset)):
            raise Refused("the version is in use")
        return self._fs.delete(self._at(dataset, "data", version), True)

    def usage(self) -> tuple[int, int]:
        """Objects and bytes in the store."""
        found = self._fs.getContentSummary(self._path(self.root))
        return found.getFileCount(), found.getLength()

    def inspect(self, dataset: str) -> dict[str, int]:
        """Rows of each table of the current version, counted in one job."""
        counts = None
        for name, df in self.tables(dataset).items():
            one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
            counts = one if counts is None else counts.union(one)
        return {r["name"]: r["n"] for r in counts.collect()} if counts is not None else {}

    def export(self, dataset: str, folder: str) -> None:
        """Each table as Parquet files under ``folder``, written in parallel."""
        for name, df in self.tables(dataset).items():
            df.write.parquet(f"{folder}/{name}")

    def drill(self, dataset: str, snapshot: str, schema_version: int, sentinel: str | None = None) -> str:
        """Whether a snapshot could be restored: absent, sentinel, corrupt, schema_mismatch or ok.

        sentinel: a table that must have rows, so that an empty object isn't taken for a good one.
        """
        try:
            kept = self._read(dataset, "snapshots", f"{snapshot}.json")
            tables = self.read_snapshot(dataset, snapshot)
            for df in tables.values():
                df.write.format("noop").mode("overwrite").save()
            if sentinel is not None and (sentinel not in tables or tables[sentinel].isEmpty()):
                return "sentinel"
        except Absent:
            return "absent"
        except Exception:  # any failure to read is what a drill is there to find
            return "corrupt"
        return "ok" if kept["schema_version"] == schema_version else "schema_mismatch"


Step = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


def replay(store: Store, dataset: str, steps: list[tuple[int, Step]], transforms: Mapping[str, Step] | None = None, names: Mapping[int, str] | None = None) -> int:
    """Run a chain of version steps, each published before the next; a failure leaves the last whole version.

    transforms: the allowed transforms by name; names: which of them follows which version, within its step.
    Steps at or below the current schema version are skipped.
    """
    for version, step in steps:
        now = store.current(dataset)
        if version <= now["schema_version"]:
            continue
        tables = step(store.tables(dataset))
        name = (names or {}).get(version)
        if name is not None:
            if name not in (transforms or {}):
                raise Refused(f"no transform {name!r}")
            tables = transforms[name](tables)
        if not isinstance(tables, dict) or not all(isinstance(t, DataFrame) for t in tables.values()):
            raise Refused(f"step {version} returned no tables")
        store.publish(dataset, tables, version, now["etag"])
    return store.current(dataset)["schema_version"]


def same(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> list[str]:
    """Names of tables that differ in types or rows, repeats counted."""
    out = sorted(set(a) ^ set(b))
    for name in sorted(set(a) & set(b)):
        if a[name].dtypes != b[name].dtypes or not a[name].exceptAll(b[name]).isEmpty() or not b[name].exceptAll(a[name]).isEmpty():
            out.append(name)
    return out
