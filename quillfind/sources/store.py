"""Tables on disk: partitioned Parquet folders behind numbered manifests."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfind.schema import NOTE_KEYS, TABLES

#: Files of exchanges go as soon as a write is over, not when the driver happens to collect its garbage. Rows that are
#: written where they are come partition by partition: a file stays open for each, and nothing is sorted.
_TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def _null(field):
    return F.lit(None).cast(field.dataType).alias(field.name)


def part_of(key: Column, parts: int) -> Column:
    """The partition of a note: every table keeps a note's rows in the same one."""
    return F.pmod(F.hash(F.coalesce(key.cast("string"), F.lit(""))), F.lit(parts)).cast("int")


class Store:
    """A folder with manifests {"parts": n, "tables": {table: {partition: version}}} and Parquet folders.

    Tables are cut in parts by a hash of the note, so a batch writes only the partitions that its notes
    are in. A save writes new versions beside the old ones and then gives the manifest of the next number
    its name, in one rename onto a name that is free: readers see all of a batch or none, and whatever
    is interrupted before leaves the manifest before. No manifest is an empty store; a broken one is an error.
    """

    def __init__(self, spark: SparkSession, root: str, parts: int = 16) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._parts = parts

    def _list(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _numbers(self) -> list[int]:
        names = (n.split("-", 1)[1][:-5] for n in self._list(self.root) if n.startswith("manifest-") and n.endswith(".json"))
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self) -> dict:
        found = self._numbers()
        if not found:
            return {"parts": self._parts, "tables": {}}
        at = f"{self.root}/manifest-{found[-1]}.json"
        return json.loads("\n".join(r[0] for r in self.spark.read.text(at).collect()))

    @property
    def parts(self) -> int:
        return self._manifest()["parts"]

    def initialize(self) -> None:
        """Create what is missing; tables that are there stay."""
        have = self._manifest()["tables"]
        self.save({name: self.spark.createDataFrame([], schema) for name, schema in TABLES.items() if name not in have})

    def exists(self, name: str) -> bool:
        return name in self._manifest()["tables"]

    def filled(self, name: str, parts: list[int]) -> bool:
        """Is anything stored in these partitions of a table?"""
        return any(int(p) in parts for p in self._manifest()["tables"].get(name, {}))

    def table(self, name: str, parts: list[int] | None = None) -> DataFrame:
        """A table, or only some of its partitions."""
        return self._read(self._manifest(), name, parts)

    def _read(self, manifest: dict, name: str, parts: list[int] | None = None) -> DataFrame:
        versions = manifest["tables"].get(name, {})
        paths = [f"{self.root}/{name}/v={v}/part={p}" for p, v in sorted(versions.items()) if parts is None or int(p) in parts]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name]).limit(0)  # which the optimizer knows to be empty

    def tables(self, parts: list[int] | None = None) -> dict[str, DataFrame]:
        manifest = self._manifest()
        return {name: self._read(manifest, name, parts) for name in TABLES}

    def parts_of(self, notes: DataFrame, column: str = "id") -> list[int]:
        """The partitions of these notes: at most as many numbers as there are partitions."""
        return sorted(r[0] for r in notes.select(part_of(F.col(column), self.parts).alias("p")).distinct().collect())

    def save(self, changed: dict[str, DataFrame], parts: list[int] | None = None, derived: dict | None = None) -> None:
        """Write changed tables and make them current together; the versions before go.

        With parts, the tables hold those partitions alone and the others stay. derived: table -> function
        of the tables just written (a dict) that gives one more, saved in the same batch; its rows come from
        partitioned tables, note by note, so they are written where they are, without an exchange.
        """
        if not changed:
            return
        number = (self._numbers() or [0])[-1]
        before = self._manifest()
        after = {"parts": before["parts"], "tables": {k: dict(v) for k, v in before["tables"].items()}}
        written: dict[str, DataFrame] = {}
        gone: list[str] = []

        def write(name: str, df: DataFrame, dealt: bool = True) -> None:
            old = after["tables"].get(name, {})
            columns = [df[f.name].cast(f.dataType).alias(f.name) if f.name in df.columns else _null(f) for f in TABLES[name].fields]
            at = f"{self.root}/{name}/v={number + 1}"
            rows = df.select(*columns).withColumn("part", part_of(F.col(NOTE_KEYS.get(name, "id")), before["parts"]))
            # Partitions are dealt out whole, and large ones split, when their sizes are known.
            rows = rows.hint("rebalance", "part") if dealt else rows
            with self._set(_TIDY if dealt else _TIDY | {"spark.sql.maxConcurrentOutputFileWriters": str(before["parts"])}):
                rows.write.mode("overwrite").partitionBy("part").option("compression", "zstd").parquet(at)
            new = {p[5:]: number + 1 for p in self._list(at) if p.startswith("part=")}
            kept = {p: v for p, v in old.items() if parts is not None and int(p) not in parts}
            gone.extend(f"{self.root}/{name}/v={v}/part={p}" for p, v in old.items() if p not in kept)
            after["tables"][name] = kept | new
            written[name] = self._read({"tables": {name: new}}, name)

        for name, df in changed.items():
            write(name, df)
        for name, make in (derived or {}).items():
            write(name, make(written), dealt=False)
        self._swap(number + 1, after)
        for path in gone:
            self._fs.delete(self._path(path), True)

    @contextlib.contextmanager
    def _set(self, options: dict[str, str]) -> Iterator[None]:
        """Options of the session for one write."""
        before = {k: self.spark.conf.get(k, None) for k in options}
        for k, v in options.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def _swap(self, number: int, manifest: dict) -> None:
        new, at = self._path(f"{self.root}/manifest.new"), self._path(f"{self.root}/manifest-{number}.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(new, at):
            raise OSError(f"could not swap {at.toString()}: another batch has taken its number")
        for n in self._numbers():
            if n < number:
                self._fs.delete(self._path(f"{self.root}/manifest-{n}.json"), False)

    def drop_all(self) -> None:
        """Delete every table and the manifests."""
        for n in self._numbers():
            self._fs.delete(self._path(f"{self.root}/manifest-{n}.json"), False)
        for name in TABLES:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def close(self) -> None:
        """Nothing is held open."""

    def _views(self) -> None:
        for name, df in self.tables().items():
            df.createOrReplaceTempView(name)

    def query(self, statement: str, params: list | None = None) -> DataFrame:
        """SQL over the tables; positional parameters."""
        self._views()
        return self.spark.sql(statement, args=params or [])

    def get(self, statement: str, params: list | None = None) -> dict | None:
        row = self.query(statement, params).limit(1).head()
        return row.asDict(True) if row else None

    def execute(self, name: str, statement: str, params: list | None = None) -> None:
        """Replace a table by what a query over the tables gives."""
        self.save({name: self.query(statement, params)})

    def insert(self, name: str, rows: DataFrame) -> None:
        """Add rows; only the partitions of their notes are written again."""
        parts = self.parts_of(rows, NOTE_KEYS.get(name, "id"))
        self.save({name: self.table(name, parts).unionByName(rows, allowMissingColumns=True)}, parts)

    def update(self, name: str, values: dict[str, str], where: str, params: dict | None = None) -> None:
        """Set columns to SQL expressions in the rows where a condition holds; :name parameters."""
        self._check(name, values)
        changed = ", ".join(f"CASE WHEN {where} THEN {values[f.name]} ELSE {f.name} END AS {f.name}" if f.name in values else f.name for f in TABLES[name].fields)
        self._rewrite(name, where, params, f"SELECT {changed} FROM {{rows}}")

    def delete(self, name: str, where: str, params: dict | None = None) -> None:
        """Delete the rows where a condition holds; :name parameters."""
        self._rewrite(name, where, params, f"SELECT * FROM {{rows}} WHERE NOT coalesce({where}, false)")

    def _check(self, name: str, values: dict[str, str]) -> None:
        unknown = set(values) - {f.name for f in TABLES[name].fields}
        if unknown or NOTE_KEYS.get(name, "id") in values:
            raise ValueError(f"columns that cannot be set: {sorted(unknown) or NOTE_KEYS.get(name, 'id')}")

    def _rewrite(self, name: str, where: str, params: dict | None, statement: str) -> None:
        """Only the partitions that hold a row where the condition is true are read again and written."""
        args = params or {}
        hit = self.spark.sql(f"SELECT {NOTE_KEYS.get(name, 'id')} AS k FROM {{rows}} WHERE {where}", args=args, rows=self.table(name))
        parts = self.parts_of(hit, "k")
        if parts:
            self.save({name: self.spark.sql(statement, args=args, rows=self.table(name, parts))}, parts)
