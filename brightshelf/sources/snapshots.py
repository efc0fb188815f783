"""Tables of many parts that change together: a version names the parts that it consists of, and is published last."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Versions that vacuum() leaves.
KEPT = 2


class Conflict(RuntimeError):
    """Another run has published a version since this one was begun."""


class Snapshots:
    """Versioned tables under a folder.

    A part is a folder of Parquet files that is written once. A version is a small file that lists the parts of each table,
    and it appears by a rename, after all its parts are there. So readers see all of a run's changes or none, and a run that
    dies leaves nothing but parts that no version names.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._known: dict[str, dict] = {}

    def _at(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def _files(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The numbers of the versions that are there, ascending."""
        files, folder = self._files(), self._at("versions")
        if not files.exists(folder):
            return []
        return sorted(int(n[:-5]) for s in files.listStatus(folder) if (n := s.getPath().getName()).endswith(".json"))

    def version(self, number: int | None = None) -> dict:
        """{"number": n, "tables": {name: [{"path": p, "at": n, "schema": s}, ...]}}: the newest, or one that is named."""
        there = self.versions()
        if number is None and not there:
            return {"number": 0, "tables": {}}
        number = there[-1] if number is None else number
        return json.loads(self.spark.read.text(f"{self.path}/versions/{number:010d}.json", wholetext=True).first()[0])

    def write(self, df: DataFrame, table: str, order: list[str | Column] | None = None, counted: bool = False) -> str:
        """A new part with the rows of ``df``, laid out by ``order``; no version names it yet. With ``counted``, versions will say
        how many rows it has."""
        name = f"parts/{table}-{uuid.uuid4().hex}"
        laid = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
        laid.write.parquet(f"{self.path}/{name}")
        self._known[name] = {"schema": df.schema.json()}
        if counted:
            self._known[name]["rows"] = self.part(name).count()
        return name

    def write_once(self, df: DataFrame, table: str, order: list[str | Column]) -> str:
        """write() of rows that are dear to make: a layout by ranges reads its input twice, so they are made as a draft first."""
        draft = self.write(df, f"draft-{table}")
        name = self.write(self.part(draft), table, order)
        self._files().delete(self._at(draft), True)
        return name

    def part(self, name: str) -> DataFrame:
        """The rows of a part that was written here."""
        return self.spark.read.schema(T.StructType.fromJson(json.loads(self._known[name]["schema"]))).parquet(f"{self.path}/{name}")

    def publish(self, base: dict, tables: dict[str, list[str]], replaced: tuple[str, ...] = ()) -> int:
        """The version after ``base``: its parts and the new ones of ``tables``, which take the place of those of ``replaced``."""
        number = base["number"] + 1
        now = {name: [] if name in replaced else list(parts) for name, parts in base["tables"].items()}
        for name, parts in tables.items():
            now.setdefault(name, []).extend({"path": p, "at": number, **self._known[p]} for p in parts)
        files, draft, final = self._files(), self._at("versions", f".{uuid.uuid4().hex}"), self._at("versions", f"{number:010d}.json")
        out = files.create(draft)
        out.write(bytearray(json.dumps({"number": number, "tables": now}).encode()))
        out.close()
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise Conflict(f"version {number} is there already")
        return number

    def parts(self, table: str, version: dict) -> list[tuple[int, DataFrame]]:
        """(version in which it was published, rows) of each part of a table, the oldest first."""
        read = lambda p: self.spark.read.schema(T.StructType.fromJson(json.loads(p["schema"]))).parquet(f"{self.path}/{p['path']}")
        return [(p["at"], read(p)) for p in version["tables"].get(table, ())]

    def rows(self, table: str, version: dict) -> DataFrame | None:
        """All rows of a table with ``at``, the version in which they came; None where it has no part."""
        every = [df.withColumn("at", F.lit(at)) for at, df in self.parts(table, version)]
        out = every[0] if every else None
        for df in every[1:]:
            out = out.unionByName(df, allowMissingColumns=True)
        return out

    def vacuum(self, keep: int = KEPT) -> int:
        """Drops all versions but the last ``keep``, and the parts that none of these names; returns the number of parts dropped.

        Not to be run while another run writes, whose parts no version names yet.
        """
        files, there = self._files(), self.versions()
        named = {p["path"] for n in there[-keep:] for parts in self.version(n)["tables"].values() for p in parts}
        for n in there[:-keep]:
            files.delete(self._at("versions", f"{n:010d}.json"), False)
        if not files.exists(self._at("parts")):
            return 0
        dropped = [n for s in files.listStatus(self._at("parts")) if f"parts/{(n := s.getPath().getName())}" not in named]
        for n in dropped:
            files.delete(self._at("parts", n), True)
        return len(dropped)
