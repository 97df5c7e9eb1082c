"""A keyed table with atomic commits (A7, A11, K7): append, skip, override and delete that survive a killed run and a second writer.

A table is a folder. Every write puts its rows into a data folder of its own, which no reader looks at, and then commits by
giving the next number to a manifest: a small JSON file that lists all data folders of that version in order. The manifest is
written under a name of its own and renamed to its number; the rename fails where that number is taken, so of two writers one
commits and the other starts again from the new version. A run that dies before the rename leaves the table as it was, and one
that is started again after it finds its keys stored. A folder that overrides or deletes lists its keys: rows of
earlier folders with these keys are hidden when the table is read, by one join for all such folders. ``compact`` writes the
visible rows as a single folder.

File system calls go through Hadoop's ``FileContext``, so the path may be on any store whose rename is atomic.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS, OVER, GONE = "rows", "override", "delete"
TRIES = 20


class Taken(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str
    keys: tuple[str, ...]

    # --- manifests ---------------------------------------------------------------------------------------------------

    def _hadoop(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._hadoop("_manifest")
        if not fs.exists(path):
            return []
        return sorted(int(n.removesuffix(".json")) for s in fs.listStatus(path) if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit())

    def entries(self, version: int | None) -> list[dict]:
        if version is None:
            return []
        path, fs = self._hadoop(f"_manifest/{version}.json")
        with_open = fs.open(path)
        try:
            return json.loads(bytes(with_open.readAllBytes()).decode())
        finally:
            with_open.close()

    def _commit(self, version: int, entries: list[dict]) -> None:
        own, fs = self._hadoop(f"_manifest/.{uuid.uuid4().hex}")
        fs.mkdirs(own.getParent())
        out = fs.create(own, False)
        out.write(json.dumps(entries).encode())
        out.close()
        jvm = self.spark._jvm
        place, _ = self._hadoop(f"_manifest/{version}.json")
        rename = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), self.spark._jsc.hadoopConfiguration()).rename(own, place, rename)
        except Exception as e:
            fs.delete(own, False)
            if "FileAlreadyExists" in str(e):
                raise Taken(f"version {version} of {self.path}") from e
            raise

    # --- reading -----------------------------------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame | None:
        """The visible rows of a version (the last one by default), or None before the first commit."""
        have = self.versions()
        if not have:
            return None
        return self._visible(self.entries(have[-1] if version is None else version))

    def _visible(self, entries: list[dict]) -> DataFrame:
        at = "__at"
        parts = [self.spark.read.parquet(f"{self.path}/{e['data']}").withColumn(at, F.lit(i)) for i, e in enumerate(entries) if e["kind"] != GONE]
        rows = functools.reduce(DataFrame.unionByName, parts)
        hiding = [self.spark.read.parquet(f"{self.path}/{e['data']}").select(*self.keys).withColumn("__by", F.lit(i))
                  for i, e in enumerate(entries) if e["kind"] != ROWS]
        if not hiding:
            return rows.drop(at)
        last = functools.reduce(DataFrame.unionByName, hiding).groupBy(*self.keys).agg(F.max("__by").alias("__by"))
        named = last.select(*[F.col(k).alias(f"__k_{k}") for k in self.keys], "__by")
        same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in self.keys])
        return rows.join(named, same, "left").where(F.col("__by").isNull() | (F.col(at) >= F.col("__by"))).select(*[c for c in rows.columns if c != at])

    # --- writing -----------------------------------------------------------------------------------------------------

    def _write(self, make: Callable[[DataFrame | None], tuple[DataFrame, str]], replace: bool = False) -> DataFrame:
        """Writes what ``make(visible rows)`` gives and commits it; on a lost race, from the new version again."""
        for _ in range(TRIES):
            have = self.versions()
            entries = self.entries(have[-1] if have else None)
            rows, kind = make(self._visible(entries) if entries else None)
            data = f"data-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/{data}")
            try:
                self._commit(have[-1] + 1 if have else 0, ([] if replace else entries) + [{"data": data, "kind": kind}])
            except Taken:
                continue
            return self.spark.read.parquet(f"{self.path}/{data}")
        raise Taken(f"{self.path}: {TRIES} other writers came first")

    def _checked(self, df: DataFrame) -> DataFrame:
        missing = [k for k in self.keys if k not in df.columns]
        if missing:
            raise ValueError(f"rows without the key columns {missing}")
        return df

    def create(self, df: DataFrame, if_exists: str = "fail") -> DataFrame | None:
        """The first version; a table that exists raises, or is left as it is with ``if_exists="ignore"``."""
        self._checked(df)
        if not self.versions():
            data = f"data-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{data}")
            try:
                self._commit(0, [{"data": data, "kind": ROWS}])
                return self.spark.read.parquet(f"{self.path}/{data}")
            except Taken:
                pass
        if if_exists == "fail":
            raise FileExistsError(self.path)
        return None

    def append(self, df: DataFrame, on_exist: str = "skip") -> DataFrame:
        """Commits rows and returns those written. ``skip`` leaves out rows whose keys are stored (so a run that is started again
        adds nothing), ``override`` hides the stored rows with these keys. Keys are equal where both are null."""
        self._checked(df)
        if on_exist not in ("skip", "override"):
            raise ValueError(f"unknown on_exist {on_exist!r}")

        def make(stored):
            if on_exist == "override":
                return df, OVER
            if stored is None:
                return df, ROWS
            known = stored.select(*[F.col(k).alias(f"__k_{k}") for k in self.keys])
            same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in self.keys])
            return df.join(known, same, "left_anti"), ROWS

        return self._write(make)

    def delete(self, keys: DataFrame) -> None:
        """Hides all rows with these keys."""
        self._checked(keys)
        if not self.versions():
            raise FileNotFoundError(self.path)
        self._write(lambda stored: (keys.select(*self.keys).distinct(), GONE))

    def compact(self) -> DataFrame:
        """The visible rows as a single data folder; earlier versions stay readable."""
        if not self.versions():
            raise FileNotFoundError(self.path)
        return self._write(lambda stored: (stored, ROWS), replace=True)
