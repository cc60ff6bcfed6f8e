"""A snapshot store: every compile writes one versioned folder of its own repository, and one small marker makes it visible.

A version number is claimed by creating a file that must not exist, so two compiles never share one. State tables hold one
repository's rows; readers take each repository's last version that has state, so repositories never overwrite each other, and
a compile writes only its own rows. State, deltas and the ledger row of a run are in the same version, so that they appear together or not at
all. All file access goes through Hadoop's file system API, so a store may be anywhere Spark can write.
"""

from __future__ import annotations

import contextlib
import time
import urllib.parse
import zlib

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph import schemas

STATE = {"entities": schemas.ENTITIES, "edges": schemas.EDGES}
LOGS = {"deltas": schemas.DELTAS, "edge_deltas": schemas.EDGE_DELTAS, "provenance": schemas.PROVENANCE, "runs": schemas.RUNS, "facts": schemas.RUN_FACTS, "artifacts": schemas.RUN_ARTIFACTS, "conflicts": schemas.CONFLICTS, "warnings": schemas.WARNINGS, "llm_cache": schemas.LLM_CACHE, "repositories": schemas.REPOSITORIES}
#: Tables that are renewed as a whole after a commit, in versions of their own that touch neither state nor logs.
SIDE = {"embeddings": schemas.EMBEDDINGS}


class LockedError(RuntimeError):
    """Another compile of the repository holds its lock."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jpath = jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._jpath(f"{self.path}/{name}"))

    def _markers(self) -> list[tuple[int, str, str]]:
        """(version, kind: s with state, l logs alone, e a side table; repository) of the committed versions, oldest first: the markers under _committed."""
        if not self._exists("_committed"):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._jpath(f"{self.path}/_committed"))]
        parts = [n.split("_", 2) for n in names if n[0].isdigit()]
        return sorted((int(v), kind, urllib.parse.unquote(repo)) for v, kind, repo in parts)

    def versions(self) -> list[int]:
        return [v for v, _, _ in self._markers()]

    def repositories(self) -> set[str]:
        return {repo for _, _, repo in self._markers()}

    def read(self, table: str) -> DataFrame:
        """State and side tables as of each repository's last version of them, logs of all versions."""
        ddl = {**STATE, **LOGS, **SIDE}[table]
        done = self._markers()
        if table in LOGS:
            wanted = [v for v, kind, _ in done if kind != "e"]
        else:
            wanted = sorted({repo: v for v, kind, repo in done if kind == ("s" if table in STATE else "e")}.values())
        if not wanted:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(*[f"{self.path}/v={v}/{table}" for v in wanted])

    def _create(self, name: str) -> bool:
        """True if this call made the file; on every file system creation without overwriting fails where it exists."""
        try:
            self._fs.create(self._jpath(f"{self.path}/{name}"), False).close()
            return True
        except Py4JJavaError:
            if self._exists(name):
                return False
            raise

    def next_version(self) -> int:
        """A number that no other compile has or gets."""
        self._fs.mkdirs(self._jpath(f"{self.path}/_claimed"))
        taken = [int(s.getPath().getName()) for s in self._fs.listStatus(self._jpath(f"{self.path}/_claimed")) if s.getPath().getName().isdigit()]
        version = max([0, *taken, *self.versions()]) + 1
        while not self._create(f"_claimed/{version}"):
            version += 1
        return version

    def commit(self, version: int, repo_id: str, tables: dict[str, DataFrame]) -> None:
        """Write the tables of a repository's version, then its marker. State tables come together or not at all (then the last state stays); logs that are not given are empty."""
        if version in self.versions():
            raise ValueError(f"version {version} is committed already")
        state, side = ([name for name in known if name in tables] for known in (STATE, SIDE))
        if side and len(tables) > len(side):
            raise ValueError("a version of a side table holds nothing else")
        if state and len(state) < len(STATE):
            raise ValueError("a version has all state tables or none")
        root = f"{self.path}/v={version}"
        self._fs.delete(self._jpath(root), True)
        for name, ddl in (SIDE if side else {**({k: STATE[k] for k in state}), **LOGS}).items():
            frame = tables.get(name)
            frame = self.spark.createDataFrame([], ddl) if frame is None else frame
            wanted = self.spark.createDataFrame([], ddl).schema
            frame.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted]).write.mode("overwrite").parquet(f"{root}/{name}")
        self._fs.mkdirs(self._jpath(f"{self.path}/_committed"))
        if not self._create(f"_committed/{version}_{'e' if side else 's' if state else 'l'}_{urllib.parse.quote(repo_id, safe='')}"):
            raise RuntimeError("the version could not be committed")

    def lock(self, repo_slug: str, lease_seconds: int = 6 * 3600):
        """A lock on a repository for as long as the context lasts; one whose holder died is free again after the lease."""

        @contextlib.contextmanager
        def held():
            name = f"_lock-{zlib.crc32(repo_slug.encode())}"
            mark = self._jpath(f"{self.path}/{name}")
            if not self._create(name):
                if not self._exists(name) or time.time() - self._fs.getFileStatus(mark).getModificationTime() / 1000 < lease_seconds:
                    raise LockedError(repo_slug)
                self._fs.delete(mark, False)
                if not self._create(name):
                    raise LockedError(repo_slug)
            try:
                yield
            finally:
                self._fs.delete(mark, False)

        return held()
