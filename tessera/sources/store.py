"""Durable state: immutable table versions under one manifest a commit, checkpoints, profiles.

A commit writes new table files, then creates ``manifest/<n>.json``; creating it fails if it exists, which is the
compare-and-set that serialises writers.  The manifest names its run and carries the run's counts, so it is the receipt, too:
a run is committed if and only if there is a manifest of it.  Readers open one manifest and so see one commit.  Files go through Hadoop's file
system API, so any store that Spark reaches and whose create-without-overwrite is atomic will do.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Column that marks rows of a delta which end the stored ones with their keys.
GONE = "is_gone"


class Conflict(RuntimeError):
    """Another writer committed first, or a guard does not hold."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _create(self, name: str, text: str) -> None:
        """Write a new small file; Conflict if it is there."""
        path = self._path(f"{self.root}/{name}")
        try:
            out = self._fs.create(path, False)
        except Exception as e:
            if self._fs.exists(path):
                raise Conflict(name) from e
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _names(self, folder: str) -> list[str]:
        p = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _read(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/{name}", wholetext=True).first().value)

    def revision(self) -> int:
        """The last commit; 0 before any."""
        return max((int(n.split(".")[0]) for n in self._names("manifest") if n.endswith(".json")), default=0)

    def manifest(self, revision: int | None = None) -> dict:
        n = self.revision() if revision is None else revision
        return self._read(f"manifest/{n:012d}.json") if n else {"tables": {}, "generations": {}, "revision": 0}

    def table(self, name: str, revision: int | None = None) -> DataFrame | None:
        """One table as of a commit.  Of rows with equal keys the one of the last commit counts; rows marked GONE are no more."""
        own = self.manifest(revision)["tables"].get(name)
        if own is None:
            return None
        parts = [self.spark.read.parquet(f"{self.root}/{p}").withColumn("__commit", F.lit(n)) for n, p in enumerate(own["paths"])]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        if own["keys"] and len(parts) > 1:
            rows = rows.withColumn("__newest", F.max("__commit").over(W.partitionBy(*own["keys"]))).where("__commit = __newest").drop("__newest")
        if GONE in rows.columns:
            rows = rows.where(~F.coalesce(GONE, F.lit(False))).drop(GONE)
        return rows.drop("__commit")

    def receipt(self, run_id: str) -> dict | None:
        """What a run committed, if it did: the manifest that names it."""
        if not self.revision():
            return None
        found = self.spark.read.text(f"{self.root}/manifest", wholetext=True).where(F.get_json_object("value", "$.run") == run_id).first()
        if found is None:
            return None
        own = json.loads(found.value)
        return {"run": run_id, "revision": own["revision"], "counts": own["counts"]}

    def commit(self, run_id: str, tables: dict[str, DataFrame], counts: dict, parent: int, generations: dict[str, int] | None = None, keys: dict[str, list[str]] | None = None) -> dict:
        """Write tables and publish them on top of ``parent``; a run that is committed commits nothing again.

        Tables named in ``keys`` add their rows to the earlier ones, and a row replaces those with its keys (none: all
        stay); other tables are replaced as a whole.
        ``generations`` claims collections: a newer generation takes over, an older or equal one of another run is refused.
        """
        if (done := self.receipt(run_id)) is not None:
            return done
        before = self.manifest(parent)
        claimed = dict(before["generations"])
        for key, generation in (generations or {}).items():
            owner, last = claimed.get(key, [None, -1])
            if generation < last or generation == last and owner != run_id:
                raise Conflict(f"collection {key} has generation {last}")
            claimed[key] = [run_id, generation]
        paths = dict(before["tables"])
        for name, df in tables.items():
            own = f"state/{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{own}")
            before_it = paths[name]["paths"] if keys and name in keys and name in paths else []
            paths[name] = {"paths": [*before_it, own], "keys": (keys or {}).get(name, [])}
        n = parent + 1
        self._create(f"manifest/{n:012d}.json", json.dumps({"tables": paths, "generations": claimed, "run": run_id, "revision": n, "counts": counts}))
        return {"run": run_id, "revision": n, "counts": counts}

    def advance(self, scope: str, expected: str | None, proposed: str) -> None:
        """Compare-and-set of a connector's cursor: revisions are files, so two writers cannot take the same step."""
        names = self._names(f"checkpoint/{scope}")
        current = self._read(f"checkpoint/{scope}/{names[-1]}")["cursor"] if names else None
        if current != expected:
            raise Conflict(f"cursor of {scope}")
        self._create(f"checkpoint/{scope}/{len(names) + 1:012d}.json", json.dumps({"cursor": proposed}))

    def cursor(self, scope: str) -> str | None:
        names = self._names(f"checkpoint/{scope}")
        return self._read(f"checkpoint/{scope}/{names[-1]}")["cursor"] if names else None

    def put_profile(self, profile_id: str, revision: int, document: dict) -> None:
        """An immutable (id, revision) document."""
        self._create(f"profile/{profile_id}/{revision:08d}.json", json.dumps(document))

    def profile(self, profile_id: str, revision: int | None = None) -> dict | None:
        names = self._names(f"profile/{profile_id}")
        wanted = names[-1:] if revision is None else [n for n in names if n == f"{revision:08d}.json"]
        return self._read(f"profile/{profile_id}/{wanted[0]}") if wanted else None

    def journal(self, run_id: str, prepared: DataFrame) -> DataFrame:
        """The run's input, written once: the first call prepares it, later ones replay it after a count and sum check."""
        path = f"{self.root}/journal/{run_id}"
        mark = f"journal-mark/{run_id}.json"
        check = lambda df: [list(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)")).cast("string")).first())]
        if f"{run_id}.json" not in self._names("journal-mark"):
            prepared.write.mode("overwrite").parquet(path)
            self._create(mark, json.dumps({"check": check(self.spark.read.parquet(path))}))
        out = self.spark.read.parquet(path)
        if check(out) != self._read(mark)["check"]:
            raise Conflict(f"journal of {run_id} changed")
        return out


def capped(snapshots: DataFrame, column: str, most: int) -> DataFrame:
    """Snapshots whose content fits the stored-bytes cap, with ``content_bytes``; larger ones keep no content."""
    size = F.octet_length(column)
    return snapshots.withColumn("content_bytes", size).withColumn(column, F.when(size <= most, F.col(column)))
