"""What a run has done to stores, kept effect by effect, so that a crash forgets none of it.

A task writes one small file for each effect as soon as the effect is done. The file's name is
the effect's own, so an attempt that carries out a task again finds what the one before it did,
takes the outcome from there and adds nothing twice. Once a run's ledger is whole, its journal
goes; a journal that is still there belongs to a run that ended early, and the next run takes its rows into
the ledger under that run's name, replacing what an earlier recovery may have put there.

The folder may be any that pyarrow reaches: a path that all executors share, s3://, gs://, hdfs://.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LEDGER


class Journal:
    """Outcomes by the names of effects."""

    def __init__(self, folder: str):
        self.fs, self.root = fs.FileSystem.from_uri(folder)

    def _path(self, effect: str) -> str:
        return f"{self.root}/{effect[:2]}/{effect}.json"

    def get(self, effect: str) -> list[dict] | None:
        if self.fs.get_file_info(self._path(effect)).type != fs.FileType.File:
            return None
        with self.fs.open_input_stream(self._path(effect)) as f:
            return [json.loads(line) for line in f.read().splitlines()]

    def put(self, effect: str, rows: list[dict]) -> None:
        """The file, a line for each row, is whole or not there."""
        path = self._path(effect)
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        beside = f"{path}.{uuid.uuid4().hex}.part"
        with self.fs.open_output_stream(beside) as f:
            f.write("\n".join(map(json.dumps, rows)).encode())
        self.fs.move(beside, path)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def journal_rows(spark: SparkSession, folder: str) -> DataFrame:
    """LEDGER's columns of all that a journal holds."""
    return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)


def settle_ledger(spark: SparkSession, rows: DataFrame, folder: str, run_id: str) -> None:
    """A run's rows into the Parquet ledger ``folder``, by run, in place of any that it had."""
    rows.where(F.col("run_id") == run_id).drop("run_id").write.mode("overwrite").parquet(f"{folder}/run_id={run_id}")


def recover(spark: SparkSession, runs: str, ledger: str) -> list[str]:
    """Takes the journals of runs that ended early into the ledger; returns those runs' names."""
    fs_, at = _fs(spark, runs)
    if not fs_.exists(at):
        return []
    out = []
    for run in sorted(x.getPath().toString() for x in fs_.listStatus(at)):
        journal = f"{run}/journal"
        _, path = _fs(spark, journal)
        if fs_.exists(path):
            run_id = run.rsplit("/", 1)[1]
            settle_ledger(spark, journal_rows(spark, journal), ledger, run_id)
            fs_.delete(path, True)
            out.append(run_id)
    return out


def close(spark: SparkSession, runs: str, run_id: str, rows: DataFrame, ledger: str, keep: int) -> None:
    """The run's whole ledger takes its journal's place; tables of all but the last ``keep`` runs go."""
    settle_ledger(spark, rows, ledger, run_id)
    fs_, journal = _fs(spark, f"{runs}/{run_id}/journal")
    fs_.delete(journal, True)
    _, at = _fs(spark, runs)
    old = sorted(((x.getModificationTime(), x.getPath().toString()) for x in fs_.listStatus(at)), reverse=True)
    for _, path in old[keep:]:
        if not path.endswith(f"/{run_id}"):
            fs_.delete(_fs(spark, path)[1], True)
