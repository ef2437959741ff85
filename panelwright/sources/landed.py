"""Tables that land date by date in a shared folder, and are read by range.

A landing writes Parquet to a folder of its own and then publishes a manifest,
which names the folder of every key (a date) that is live. Readers take the
newest manifest and open the folders of the keys that they ask for, no others:
a date is replaced for all of its rows or for none, and who began to read before
goes on with the rows of that time. All paths go through Spark's file systems.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_COPY, _MANIFEST = "landed key", re.compile(r"([0-9]{12})\.json")


class LandedTable:
    """key: the column, a string of letters, digits, - and _, whose order is the
    range's (yyyyMMdd). Columns may come and go from one landing to the next:
    those that a date lacks are NULL. A column keeps the type it came with."""

    def __init__(self, spark: SparkSession, root: str, key: str = "trade_date") -> None:
        self.spark, self.key = spark, key
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        at = self._path(str(root))
        self._files = at.getFileSystem(conf)
        self.root = self._files.makeQualified(at).toString()
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), conf)
        # Parquet refuses some characters in names; the copied column is only ever a folder's name
        self._never_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return [x.getPath().getName() for x in self._files.listStatus(at)] if self._files.exists(at) else []

    def _newest(self) -> tuple[int, dict[str, Any]]:
        known = [int(m[1]) for x in self._names("manifest") if (m := _MANIFEST.fullmatch(x))]
        if not known:
            return -1, {"schema": {"type": "struct", "fields": []}, "live": {}}
        file = f"{self.root}/manifest/{max(known):012d}.json"
        return max(known), json.loads(self.spark.read.text(file, wholetext=True).first()[0])

    def _publish(self, number: int, manifest: dict[str, Any]) -> bool:
        """False if another writer took the number: no manifest is ever replaced."""
        part = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = self._files.create(part, False)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        try:
            self._context.rename(part, self._path(f"{self.root}/manifest/{number:012d}.json"), self._never_overwrite)
        except Py4JJavaError as e:
            self._files.delete(part, False)
            if "FileAlreadyExistsException" in e.java_exception.toString():
                return False
            raise
        return True

    def keys(self) -> list[str]:
        return sorted(self._newest()[1]["live"])

    def land(self, rows: DataFrame) -> list[str]:
        """Adds or replaces the keys that rows have, all in one step. A key with
        very many rows is written by several tasks. Nothing of an empty frame lands.
        ValueError for a key that is NULL or has other characters."""
        run = f"data/{uuid.uuid4().hex}"
        copied = rows.withColumn(_COPY, F.col(f"`{self.key}`").cast("string"))
        copied.hint("rebalance", F.col(f"`{_COPY}`")).write.partitionBy(_COPY).parquet(f"{self.root}/{run}")
        folders = {x.split("=", 1)[1]: f"{run}/{x}" for x in self._names(run) if "=" in x}
        if odd := sorted(x for x in folders if not re.fullmatch(r"[0-9A-Za-z-][0-9A-Za-z_-]*", x)):
            self._files.delete(self._path(f"{self.root}/{run}"), True)
            raise ValueError(f"keys that can't be landed: {odd[:5]}")
        fields = {f["name"]: f for f in json.loads(rows.schema.json())["fields"]}
        while folders:
            number, manifest = self._newest()
            before = {f["name"]: f for f in manifest["schema"]["fields"]}
            if changed := [c for c in fields if c in before and before[c]["type"] != fields[c]["type"]]:
                self._files.delete(self._path(f"{self.root}/{run}"), True)
                raise ValueError(f"columns of another type than before: {changed}")
            schema = {"type": "struct", "fields": list((fields | before).values())}
            if self._publish(number + 1, {"schema": schema, "live": manifest["live"] | folders}):
                break
        return sorted(folders)

    def scan(self, start: str | None = None, end: str | None = None, keys: list[str] | None = None) -> DataFrame:
        """The rows of the live keys from start to end (both included), or of the
        named ones; keys that never landed have none."""
        manifest = self._newest()[1]
        schema = StructType.fromJson(manifest["schema"])
        wanted = None if keys is None else set(keys)
        live = [at for k, at in sorted(manifest["live"].items()) if (not start or k >= start) and (not end or k <= end) and (wanted is None or k in wanted)]
        if not live:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{at}" for at in live))

    def vacuum(self) -> int:
        """Deletes the folders of replaced keys and all manifests but the newest;
        returns the number of folders. Not while others land or still read old dates."""
        number, manifest = self._newest()
        live, gone = set(manifest["live"].values()), 0
        for run in self._names("data"):
            for x in self._names(f"data/{run}"):
                if "=" in x and f"data/{run}/{x}" not in live:
                    gone += bool(self._files.delete(self._path(f"{self.root}/data/{run}/{x}"), True))
        for x in self._names("manifest"):
            if x != f"{number:012d}.json":
                self._files.delete(self._path(f"{self.root}/manifest/{x}"), False)
        return gone
