"""Phase tables that survive a restart of the driver.

A phase is a table under ``root/<name>/``. Its fingerprint covers its name, its
parameters, the files of its input paths (path, size, time of change) and the
fingerprints of the phases it reads. A run writes to a folder of its own, and
only when Spark has committed that, a mark ``<fingerprint>.json`` beside it
names the folder and the schema. A later run with the same fingerprint reads the
marked folder; without a mark nothing is read, so a half-written table never is.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Phases:
    """Committed phase tables below ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.used = spark, root.rstrip("/"), {}

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, path: str) -> str | None:
        fs, p = self._fs(), self._path(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, path: str, text: str) -> None:
        """The whole text or nothing: written under another name first."""
        fs, part = self._fs(), self._path(f"{path}.{uuid.uuid4().hex}.part")
        stream = fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not fs.rename(part, self._path(path)):
            fs.delete(part, False)                      # another driver has set the same mark

    def files(self, path: str) -> list[list]:
        """(path, length, time of change) of the files below ``path``; listed by the driver, one entry a file."""
        p = self._path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found, out = fs.listFiles(p, True), []
        while found.hasNext():
            f = found.next()
            out.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
        return sorted(out)

    def fingerprint(self, name: str, inputs: list[str], after: list[str], params: dict) -> str:
        what = [name, params, [self.files(i) for i in inputs], [self.used[a] for a in after]]
        return hashlib.sha256(json.dumps(what, sort_keys=True).encode()).hexdigest()

    def table(self, name: str, build: Callable[[], DataFrame], inputs: list[str] = (), after: list[str] = (), params: dict | None = None) -> DataFrame:
        """The phase's table: as committed before, if nothing it depends on has changed; else built, written and marked.

        inputs: paths whose files it reads; after: names of phases already
        asked for whose tables it reads; params: what else the result depends
        on (a version of the code among them, where that matters).
        """
        key = self.fingerprint(name, list(inputs), list(after), params or {})
        self.used[name] = key
        mark = f"{self.root}/{name}/{key}.json"
        known = self._read(mark)
        if known is None:
            folder = f"{self.root}/{name}/data-{uuid.uuid4().hex}"
            built = build()
            built.write.mode("errorifexists").parquet(folder)
            self._write(mark, json.dumps({"folder": folder, "schema": built.schema.jsonValue(), "params": params or {}, "at": time.time()}, sort_keys=True))
            known = self._read(mark)
        entry = json.loads(known)
        return self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(entry["folder"])

    def _listed(self) -> list:
        fs, root = self._fs(), self._path(self.root)
        if not fs.exists(root):
            return []
        return [s.getPath() for d in fs.listStatus(root) if d.isDirectory() for s in fs.listStatus(d.getPath())]

    def stale(self) -> list[str]:
        """Folders that no mark names, marks of fingerprints that this run has not asked for with their folders, and parts of marks.

        Ask for all phases first. Nothing is deleted here: another driver may be writing below the same root.
        """
        live, out = set(), []
        for name, key in self.used.items():
            known = self._read(f"{self.root}/{name}/{key}.json")
            live.add(f"{key}.json")
            if known:
                live.add(json.loads(known)["folder"].rsplit("/", 1)[1])
        for p in self._listed():
            if p.getName() not in live:
                out.append(p.toString())
        return sorted(out)
