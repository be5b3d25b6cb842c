"""Exactly-once results of ``foreachBatch``: a ledger of batches, committed with what they wrote.

Spark may run a micro-batch again: the driver can be lost after a step has written and before
its checkpoint says so.  Here a step's tables are written to a folder of that attempt, and the batch is
committed by creating one small file that names the attempt, which only one attempt can do.  A batch
that the ledger has is not run again; what an attempt wrote that no ledger entry names is not read.
The ledger's key is (query, batch): queries share a folder and don't see each other's batches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

Step = Callable[[DataFrame, int], dict[str, DataFrame]]


class Files:
    """A folder's files by Spark's own file systems, so that any store that Spark reads will do."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self) -> list[str]:
        if not self.fs.exists(self._path("")):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path("")) if not s.getPath().getName().startswith((".", "_")))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file of that name if there is none; whether this call did.

        The text is whole under a name of its own before it gets the name that counts, so no
        reader sees half of it.
        """
        self.fs.mkdirs(self._path(""))
        own = self._path(f".{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(own, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
            context.rename(own, self._path(name), options)  # fails if the name is taken
            return True
        except Py4JJavaError as e:
            self.fs.delete(own, False)
            if "FileAlreadyExists" in str(e.java_exception) or self.fs.exists(self._path(name)):
                return False
            raise


class Ledger:
    """What a query's batches have written."""

    def __init__(self, spark: SparkSession, folder: str, query: str) -> None:
        self.spark, self.folder, self.query = spark, folder.rstrip("/"), query
        self.files = Files(spark, f"{self.folder}/ledger/{query}")

    def entries(self) -> dict[int, dict]:
        return {int(n): json.loads(self.files.read(n)) for n in self.files.names()}

    def run(self, step: Step, before_commit: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
        """``step`` as a function for ``foreachBatch``; it returns its tables by name.

        ``before_commit`` is for tests: it may raise between writing and committing.
        """

        def once(batch: DataFrame, batch_id: int) -> None:
            name = f"{batch_id:012d}"
            if name in self.files.names():
                return
            attempt = uuid.uuid4().hex
            tables = step(batch, batch_id)
            for table, df in tables.items():
                df.write.parquet(f"{self.folder}/{self.query}/{table}/{attempt}")
            if before_commit is not None:
                before_commit(batch_id)
            self.files.create(name, json.dumps({"attempt": attempt, "tables": {t: df.schema.json() for t, df in tables.items()}}))

        return once

    def table(self, name: str, schema: str) -> DataFrame:
        """A table over all committed batches."""
        paths = [f"{self.folder}/{self.query}/{name}/{e['attempt']}" for e in self.entries().values() if name in e["tables"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def last(self, name: str, schema: str | StructType, before: int) -> DataFrame:
        """A table as the last committed batch before another has written it."""
        of = {b: e for b, e in self.entries().items() if b < before}
        if not of or name not in of[max(of)]["tables"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{self.query}/{name}/{of[max(of)]['attempt']}")

    def compact_log(self, through: int) -> int:
        """How many entries up to a batch there are; attempts that no entry names are removed."""
        entries = self.entries()
        named = {e["attempt"] for e in entries.values()}
        top = Files(self.spark, f"{self.folder}/{self.query}")
        for table in top.names():
            of = Files(self.spark, f"{self.folder}/{self.query}/{table}")
            for attempt in of.names():
                if attempt not in named:
                    of.fs.delete(of._path(attempt), True)
        return sum(1 for b in entries if b <= through)
