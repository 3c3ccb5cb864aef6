"""A prediction table with many readers: attempts are staged, a manifest entry makes one visible."""

from __future__ import annotations

import json
import os
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foresight import contract
from foresight.sources.store import checked_predictions, conform_columns, write_counted

ENTRY_SCHEMA = "version bigint, run_id string, attempt string, token string, total_records bigint"
#: Times that a writer looks for the next free version when others commit alongside.
TRIES = 50


class CommittedTable:
    """Predictions under ``path``: ``data/<attempt>`` holds rows, ``manifest/`` says which attempts count.

    Phase one writes a run's rows under a fresh attempt, checked on the way; nobody reads them yet, and
    a job that dies leaves only files that no entry names. Phase two adds one manifest entry by giving
    a small file the name of the next version, which a file system does wholly or not at all and refuses
    if another writer was faster. A run's latest entry is what readers see, so a reader never meets half
    a run, and one that has planned its scan keeps the attempt it saw. The manifest has a row per commit.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.data, self.manifest = f"{self.path}/data", f"{self.path}/manifest"
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _at(self, path: str):
        at = self._hadoop.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        at, files = self._at(path)
        return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []

    def entries(self) -> DataFrame:
        """All commits, one row each."""
        if not any(n.startswith("v") for n in self._names(self.manifest)):
            return self.spark.createDataFrame([], ENTRY_SCHEMA)
        return self.spark.read.schema(ENTRY_SCHEMA).json(f"{self.manifest}/v*.json")

    def current(self) -> DataFrame:
        """The entry that counts for each run."""
        newest = Window.partitionBy("run_id").orderBy(F.desc("version"))
        return self.entries().withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")

    def stage(self, run_id: str, predictions: DataFrame) -> tuple[str, int]:
        """Phase one: attempt and number of rows. A row that breaks a rule fails the job."""
        attempt = uuid4().hex
        rows = conform_columns(checked_predictions(predictions, run_id), contract.CUSTOMER_PREDICTIONS)
        return attempt, write_counted(rows, f"{self.data}/{attempt}")

    def _claim(self, draft, final, files) -> bool:
        """Give the draft its final name unless another writer holds that; local renames would replace it."""
        if files.getUri().getScheme() != "file":
            return not files.exists(final) and files.rename(draft, final)
        source, target = (files.makeQualified(p).toUri().getPath() for p in (draft, final))
        try:
            os.link(source, target)
        except FileExistsError:
            return False
        files.delete(draft, False)
        return True

    def commit(self, run_id: str, attempt: str, total: int, token: str | None = None) -> int:
        """Phase two: the version under which the attempt counts from now on."""
        entry = {"run_id": run_id, "attempt": attempt, "token": token, "total_records": total}
        for _ in range(TRIES):
            taken = [int(n[1:-5]) for n in self._names(self.manifest) if n.startswith("v") and n.endswith(".json")]
            version = max(taken, default=0) + 1
            draft, files = self._at(f"{self.manifest}/.draft-{uuid4().hex}")
            stream = files.create(draft, False)
            stream.write(bytearray((json.dumps({"version": version, **entry}) + "\n").encode()))
            stream.close()
            final, _ = self._at(f"{self.manifest}/v{version:012d}.json")
            if self._claim(draft, final, files):
                return version
            files.delete(draft, False)
        raise RuntimeError(f"no free manifest version for run {run_id} after {TRIES} tries")

    def append(self, run_id: str, predictions: DataFrame, token: str | None = None, batch_size: int = contract.WRITE_BATCH) -> dict:
        """Store a run's predictions, all or nothing; a later call for the run replaces it.

        A retry with the ``token`` of a commit that came through writes nothing and returns its summary.
        """
        known = None
        if token is not None:
            known = self.entries().filter((F.col("run_id") == run_id) & (F.col("token") == token)).first()
        if known is not None:
            total, version = known["total_records"], known["version"]
        else:
            attempt, total = self.stage(run_id, predictions)
            version = self.commit(run_id, attempt, total, token)
        return {
            "status": "success",
            "run_id": run_id,
            "version": version,
            "total_records": total,
            "batch_count": -(-total // batch_size),
        }

    def read(self) -> DataFrame:
        """Rows of the attempts that count; the others' folders are not opened."""
        counting = [r.attempt for r in self.current().select("attempt").collect()]  # one row a run
        if not counting:
            return self.spark.createDataFrame([], contract.CUSTOMER_PREDICTIONS)
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.data}/{a}" for a in counting])

    def vacuum(self, keep: int = 1) -> int:
        """Delete attempts beyond the latest ``keep`` commits of their run; returns how many.

        Staged attempts that were never committed go as well, so no writer may be at work meanwhile.
        """
        newest = Window.partitionBy("run_id").orderBy(F.desc("version"))
        kept = self.entries().withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= keep)
        wanted = {r.attempt for r in kept.select("attempt").collect()}
        stale = [a for a in self._names(self.data) if a not in wanted]
        for attempt in stale:
            at, files = self._at(f"{self.data}/{attempt}")
            files.delete(at, True)
        return len(stale)
