"""Tables of one row a key that several writers may change at once: data files never change, a version lists those that count."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIES = 20


class Conflict(RuntimeError):
    """Other writers were faster TRIES times in a row."""


class KeyedTable:
    """A folder with Parquet data and numbered versions. Readers see whole versions only.

    A writer reads the newest version, writes its rows beside the old files, and then creates the file of
    the next version, which fails if another writer has made it first (on HDFS and stores that
    create files conditionally this is atomic). It then looks at what the other one added, and tries
    again. So two writers cannot both add a key, and neither loses the other's rows. What a writer that failed
    has left is not in any version.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys
        self._hadoop = spark._jvm.org.apache.hadoop
        self._fs = self._hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self._hadoop.fs.Path("/".join((self.path, *names)))

    def _listed(self, version: int, wait: float = 2.0) -> list[str] | None:
        """The data folders of a version; None if its writer died before it had written the list."""
        end = time.monotonic() + wait
        while True:
            stream = self._fs.open(self._at("versions", f"{version:09d}"))
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if text.endswith("\n"):
                return json.loads(text)
            if time.monotonic() > end:
                return None
            time.sleep(0.1)

    def version(self) -> tuple[int, int, list[str]]:
        """The last number taken, the newest whole version (0: none) and its data folders."""
        if not self._fs.exists(self._at("versions")):
            return 0, 0, []
        numbers = sorted((int(s.getPath().getName()) for s in self._fs.listStatus(self._at("versions")) if s.getPath().getName().isdigit()), reverse=True)
        for n in numbers:
            if (folders := self._listed(n)) is not None:
                return numbers[0], n, folders
        return max(numbers, default=0), 0, []

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of an earlier one."""
        return self._rows(self.version()[2] if version is None else self._listed(version) or [])

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        return name

    def _commit(self, number: int, folders: list[str]) -> bool:
        try:
            out = self._fs.create(self._at("versions", f"{number:09d}"), False)
        except Exception as error:  # a Java exception behind Py4J
            if "AlreadyExists" in str(error) or "already exists" in str(error):
                return False
            raise
        try:
            out.write(bytearray((json.dumps(folders) + "\n").encode()))
        finally:
            out.close()
        return True

    def _new(self, rows: DataFrame, old: DataFrame) -> DataFrame:
        old = old.select(*[F.col(k).alias(f"_{k}") for k in self.keys])
        on = [rows[k].eqNullSafe(old[f"_{k}"]) for k in self.keys]
        return rows.join(old, on, "left_anti")

    def add(self, rows: DataFrame, before_commit: Callable[[], None] | None = None) -> int:
        """Add the rows whose keys the table lacks (of rows alike in key, one); the version made. Old rows stay as they are.

        The rows are written once, with their new keys only. After a conflict just the folders that came
        in between are looked at. before_commit is called before each try (for tests).
        """
        names = [c.split()[0] for c in self.schema.split(", ")]
        taken, _, base = self.version()
        mine = self._write(self._new(rows.select(*names).dropDuplicates(self.keys), self._rows(base)))
        for _ in range(TRIES):
            if before_commit:
                before_commit()
            if self._commit(taken + 1, [*base, mine]):
                return taken + 1
            taken, _, now = self.version()
            if between := [f for f in now if f not in base]:
                mine = self._write(self._new(self._rows([mine]), self._rows(between)))
            if any(f not in now for f in base):  # replaced in between
                mine = self._write(self._new(self._rows([mine]), self._rows(now)))
            base = now
        raise Conflict(self.path)

    def replace(self, rows: DataFrame, before_commit: Callable[[], None] | None = None) -> int:
        """Put the rows (one a key) in place of old ones of their keys, and add the others; the version made. The whole table is written anew."""
        names = [c.split()[0] for c in self.schema.split(", ")]
        mine = self._write(rows.select(*names).dropDuplicates(self.keys))
        for _ in range(TRIES):
            taken, _, base = self.version()
            kept = self._write(self._new(self._rows(base), self._rows([mine])))
            if before_commit:
                before_commit()
            if self._commit(taken + 1, [kept, mine]):
                return taken + 1
        raise Conflict(self.path)
