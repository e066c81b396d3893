"""A log table with optimistic commits: data first, then one version file that must not exist yet."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfold.operators.lineage import shared_dir
from logfold.sources import hadoop

ATTEMPTS = 32
#: Versions between summaries of all before them.
SUMMARY = 64


class Conflict(RuntimeError):
    """Another writer took the version and the commit doesn't hold on top of it."""


class LogTable:
    """Parquet data under root/data, versions under root/versions. A version is the only thing that makes data visible.

    `hook` is called with a name at each boundary of a commit; tests raise from it to stand in for crashes."""

    def __init__(self, spark: SparkSession, root: str, schema, hook: Callable[[str], None] = lambda _: None):
        self.spark, self.root, self.schema, self.hook = spark, root, schema, hook

    def initialise(self, head: str = "refs/heads/main", object_format: str = "sha1") -> None:
        """Creates the table; an existing one must have the same head and format."""
        want = {"version": 2, "head": head, "object_format": object_format}
        path = f"{self.root}/table.json"
        if not hadoop.create(self.spark, path, json.dumps(want).encode()) and json.loads(hadoop.read(self.spark, path)) != want:
            raise ValueError("the table exists with another head or object format")

    def versions(self) -> list[str]:
        return [n for n in hadoop.names(self.spark, f"{self.root}/versions") if n.startswith("v") and n.endswith(".json")]

    def version(self, name: str) -> dict:
        return json.loads(hadoop.read(self.spark, f"{self.root}/versions/{name}"))

    def _marker(self, batch: str) -> str:
        return f"{self.root}/batches/{hashlib.sha256(batch.encode()).hexdigest()}.json"

    def _committed(self, names: list[str], batch: str) -> int | None:
        """The version of a batch, from its marker or the last version: every version before that has a marker."""
        if names and self.version(names[-1])["batch"] == batch:
            return len(names) - 1
        marker = hadoop.read_if_exists(self.spark, self._marker(batch))
        return json.loads(marker)["version"] if marker else None

    def _settle(self, names: list[str]) -> None:
        """Gives the last version the marker, and the summary, that its writer may not have lived to write."""
        if not names:
            return
        n = len(names) - 1
        hadoop.create(self.spark, self._marker(self.version(names[-1])["batch"]), json.dumps({"version": n}).encode())
        if len(names) % SUMMARY == 0:
            hadoop.create(self.spark, f"{self.root}/summaries/s{n:020d}.json", json.dumps(self._data(names)).encode())

    def _data(self, names: list[str]) -> list[str]:
        """The data folder of each version, from the last summary and the versions after it."""
        known = [x for x in hadoop.names(self.spark, f"{self.root}/summaries") if x[1:21] <= names[-1][1:21]] if names else []
        data = json.loads(hadoop.read(self.spark, f"{self.root}/summaries/{known[-1]}")) if known else []
        return data + [self.version(v)["data"] for v in names[len(data) :]]

    def commit(self, rows: DataFrame, batch: str, check: Callable[[DataFrame], bool] | None = None) -> int:
        """Appends rows as one version and returns its number. A batch id that is committed already changes nothing.

        A commit reads a bounded number of files, whatever the number of versions. check is asked with the state before
        each attempt; if it fails the batch conflicts and nothing of it shows."""
        done = self._committed(self.versions(), batch)
        if done is not None:
            return done
        data = f"{self.root}/data/{uuid.uuid4().hex}"
        self.hook("before-data")
        rows.write.parquet(data)
        self.hook("after-data")
        for _ in range(ATTEMPTS):
            names = self.versions()
            done = self._committed(names, batch)
            if done is not None:
                return done
            self._settle(names)
            if check and not check(self.read()):
                raise Conflict(batch)
            self.hook("before-version")
            body = json.dumps({"batch": batch, "data": data.removeprefix(self.root)}).encode()
            if hadoop.create(self.spark, f"{self.root}/versions/v{len(names):020d}.json", body):
                self.hook("after-version")
                return len(names)
        raise Conflict(f"{batch}: {ATTEMPTS} attempts lost")

    def read(self, after: int = -1) -> DataFrame:
        """Rows of all versions after a number."""
        paths = [self.root + d for d in self._data(self.versions())[after + 1 :]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: the stream's batch id makes a replay harmless."""
        return lambda rows, batch: None if rows.isEmpty() else (self.commit(rows, f"batch-{batch}"), None)[1]


def replayed(updates: DataFrame, buckets: int) -> DataFrame:
    """Streams updates, in files of `buckets` parts, into a log table of its own, and reads what it committed."""
    spark = updates.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    updates.repartition(buckets, F.col("event_id")).write.parquet(f"{root}/in")
    table = LogTable(spark, f"{root}/log", updates.schema)
    table.initialise()
    stream = spark.readStream.schema(updates.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    stream.writeStream.foreachBatch(table.sink()).option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start().awaitTermination()
    return table.read()
