"""Versioned tables that commit together, with appends and deletions that leave what is there in place.

A table is a list of parts, each a Parquet folder that one version wrote, and of deletions, each a folder of keys that hide rows of
older parts. A version is a JSON marker that names the parts of every table; it is created last and makes the version visible, so
an interrupted writer leaves the old one. Tables that a commit doesn't touch are carried forward by name. A table of more than
``PARTS`` parts is written anew as one. One writer at a time is assumed.

A table that is merged by key lies in buckets by a hash of the key, a part for each. merge() rewrites the buckets in which a row
is new, differs or goes, and carries the others forward by name; what it compares with is read from the buckets that it is given.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MARKER = "_COMMITTED"
PARTS = 16
#: Buckets of a table that is merged by key; a table keeps the number it began with.
BUCKETS, _BUCKET = 32, "__bucket"
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
_AT, _DELETED = "__version", "__deleted_at"


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._seen = spark.sparkContext._jvm, 0
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and self._marked(int(n[1:])))

    def _marked(self, version: int) -> bool:
        return self._fs.exists(self._path(f"{_folder(version)}/{MARKER}"))

    def newest(self) -> int:
        """The newest version, 0 if there is none. Versions follow each other, so that from the last one seen only the next are looked for."""
        if not self._seen or not self._marked(self._seen):
            self._seen = (self.versions() or [0])[-1]
        while self._seen and self._marked(self._seen + 1):
            self._seen += 1
        return self._seen

    def content(self, version: int | None = None) -> dict[str, list[dict]]:
        """Parts and deletions of every table of a version, the newest by default: {"at", "rows"} or {"at", "gone", "key"}."""
        if version is None:
            version = self.newest()
        return json.loads(self._text(f"{_folder(version)}/{MARKER}")) if version else {}

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, table: str, schema: str | StructType) -> DataFrame:
        """The newest version's table, or an empty one."""
        return self._rows(self.content().get(table, []), schema)

    def _rows(self, entries: list[dict], schema: str | StructType) -> DataFrame:
        buckets = [f"{self.root}/{e['rows']}" for e in entries if "bucket" in e]
        if buckets:
            return self.spark.read.schema(schema).parquet(*buckets)
        given = [e for e in entries if "rows" in e]
        if not given:
            return self.spark.createDataFrame([], schema)
        # Parts as new as the last deletion are hidden by none, and meet none; the others, and the deletions of a key, are read as one
        # each, however many there are, and tell their version by the folder that they lie in.
        newest = max((e["at"] for e in entries if "gone" in e), default=0)
        newer, older = ([f"{self.root}/{e['rows']}" for e in given if (e["at"] >= newest) == new] for new in (True, False))
        read = self.spark.read.schema(schema)
        if not older:
            return read.parquet(*newer)
        version = F.regexp_extract(F.col("_metadata.file_path"), r".*/v(\d+)/", 1).cast("long")
        rows = read.parquet(*older).select("*", version.alias(_AT))
        gone: dict[str, list[str]] = {}
        for e in entries:
            if "gone" in e:
                gone.setdefault(e["key"], []).append(f"{self.root}/{e['gone']}")
        for key, own in gone.items():
            last = self.spark.read.parquet(*own).select(F.col(key).alias("__key"), version.alias(_DELETED)).groupBy("__key").agg(F.max(_DELETED).alias(_DELETED))
            rows = rows.join(last, (rows[key] == last["__key"]) & (rows[_AT] < last[_DELETED]), "left_anti")
        rows = rows.drop(_AT)
        return rows.unionByName(read.parquet(*newer)) if newer else rows

    def begin(self) -> Transaction:
        return Transaction(self)

    def commit(self, tables: dict[str, DataFrame], partitions: dict[str, list[str]] | None = None) -> int:
        """Put tables in place of those of their names, as the next version; they may read the current one."""
        change = self.begin()
        for name, df in tables.items():
            change.replace(name, df, (partitions or {}).get(name, ()))
        return change.commit()

    def expire(self, keep: int = 2) -> None:
        """Delete the markers of all but the newest versions, and every folder that no kept version names."""
        known = self.versions()
        kept = known[-keep:]
        named = {e.get("rows", e.get("gone")) for v in kept for entries in self.content(v).values() for e in entries}
        for version in known[:-keep]:
            self._fs.delete(self._path(f"{_folder(version)}/{MARKER}"), False)
            for status in self._fs.listStatus(self._path(_folder(version))):
                name = f"{_folder(version)}/{status.getPath().getName()}"
                if name in named:
                    continue
                buckets = {x.rsplit("/", 1)[1] for x in named if x.startswith(f"{name}/")}
                for unused in [s.getPath() for s in self._fs.listStatus(self._path(name)) if s.getPath().getName() not in buckets] if buckets else [self._path(name)]:
                    self._fs.delete(unused, True)


def _folder(version: int) -> str:
    return f"v{version:08d}"


class Transaction:
    """The next version while it is written. Nothing of it is visible before commit()."""

    def __init__(self, store: SnapshotStore) -> None:
        self.store = store
        newest = store.newest()
        self.version = newest + 1
        self.tables = store.content(newest)
        self._spools: list[str] = []
        store._fs.delete(store._path(_folder(self.version)), True)

    def _write(self, name: str, df: DataFrame, partitions: Sequence[str] = ()) -> str:
        place = f"{_folder(self.version)}/{name}"
        writer = df.write.option("compression", "zstd")
        conf, before = self.store.spark.conf, self.store.spark.conf.get(_WRITERS)
        if partitions:
            conf.set(_WRITERS, str(max(BUCKETS, int(before))))  # a task has an open file for each of a few folders, and sorts no rows
        try:
            (writer.partitionBy(*partitions) if partitions else writer).parquet(f"{self.store.root}/{place}")
        finally:
            conf.set(_WRITERS, before)
        return place

    def replace(self, name: str, df: DataFrame, partitions: Sequence[str] = ()) -> None:
        self.tables[name] = [{"at": self.version, "rows": self._write(name, df, partitions)}]

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Add rows to a table; gives them back as written, so that what is derived from them reads them and not their plan."""
        place = self._write(name, df)
        self.tables[name] = [*self.tables.get(name, []), {"at": self.version, "rows": place}]
        return self.store.spark.read.schema(df.schema).parquet(f"{self.store.root}/{place}")

    def spool(self, name: str, df: DataFrame) -> DataFrame:
        """df as written for the time of the transaction; no version names it."""
        place = self._write(f"{name}.spool", df)
        self._spools.append(place)
        return self.store.spark.read.schema(df.schema).parquet(f"{self.store.root}/{place}")

    def drop_spools(self) -> None:
        for spool in self._spools:
            self.store._fs.delete(self.store._path(spool), True)

    def delete(self, name: str, keys: DataFrame) -> None:
        """Hide the rows of older versions whose key is among keys (one column, named as the key)."""
        [key] = keys.columns
        if any("rows" in e and e["at"] < self.version for e in self.tables.get(name, [])):
            self.tables[name] = [*self.tables[name], {"at": self.version, "gone": self._write(f"{name}.gone", keys.distinct()), "key": key}]

    def delete_from(self, names: Sequence[str], keys: DataFrame) -> None:
        """delete() from several tables by keys that are distinct, written once."""
        [key], place = keys.columns, ""
        for name in names:
            if any("rows" in e and e["at"] < self.version for e in self.tables.get(name, [])):
                place = place or self._write(f"{name}.gone", keys)
                self.tables[name] = [*self.tables[name], {"at": self.version, "gone": place, "key": key}]

    def merge(self, name: str, rows: DataFrame, key: Sequence[str], gone: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
        """Put rows in place of those with equal keys, and take out those of ``gone`` (the key's columns) that are not among them.

        Gives back the rows that are new or differ, to be read before the commit. rows must have one row a key, which is checked, and
        is written once. A table that lies in other parts yet is first dealt out by key.
        """
        schema, columns, root = rows.schema, rows.columns, self.store.root
        old = self.tables.get(name, [])
        of = next((e["of"] for e in old if "of" in e), buckets)
        bucket = F.pmod(F.xxhash64(*key), F.lit(of)).cast("int")

        def among(numbers: list[int]) -> DataFrame:
            return self.store._rows([e for e in old if e.get("bucket", -1) in numbers], schema).withColumn(_BUCKET, bucket)

        def numbers_of(df: DataFrame) -> list[int]:
            return [r[0] for r in df.select(_BUCKET).distinct().collect()]  # at most as many as there are buckets

        if old and not any("bucket" in e for e in old):
            before = self.store._rows(old, schema).select(*columns)
            before = before if gone is None else before.join(gone.select(*key), list(key), "left_anti")
            rows, old = upsert(before, rows, list(key)), []
        if not old:
            # All is new: the rows go to their buckets at once, and are checked there before anything can see them.
            place = self._write(name, rows.withColumn(_BUCKET, bucket).repartition(F.col(_BUCKET)), [_BUCKET])
            given = self.store.spark.read.schema(schema).parquet(f"{root}/{place}")
            assert_unique(given, list(key))
            self.tables[name] = self._buckets(place, range(of), of)
            return given
        spool = self._write(f"{name}.rows", rows)
        self._spools.append(spool)
        given = self.store.spark.read.schema(schema).parquet(f"{root}/{spool}")
        assert_unique(given, list(key))
        given = given.withColumn(_BUCKET, bucket)
        # Rows that are there already change nothing, so that a bucket which only such rows fall into is left alone. What is
        # compared are digests of 128 bits; only rows of those that are new are read again.
        place = self._write(f"{name}.digests", _digests(given, columns).join(_digests(among(numbers_of(given)), columns), list(_DIGEST), "left_anti"))
        self._spools.append(place)
        new = self.store.spark.read.parquet(f"{root}/{place}")
        news = self._write(f"{name}.changed", given.withColumns(_digest(columns)).join(new, list(_DIGEST), "left_semi").select(*columns))
        self._spools.append(news)
        changed = self.store.spark.read.schema(schema).parquet(f"{root}/{news}").withColumn(_BUCKET, bucket)
        touched = set(numbers_of(changed))
        if gone is not None:
            gone = gone.select(*key).distinct().withColumn(_BUCKET, bucket)
            touched |= set(numbers_of(among(numbers_of(gone)).join(gone, list(key), "left_semi")))
        entries = [e for e in old if e["bucket"] not in touched]
        if touched:
            kept = among(sorted(touched))
            kept = kept if gone is None else kept.join(gone.select(*key), list(key), "left_anti")
            whole = upsert(kept.select(*columns), changed.select(*columns), list(key)).withColumn(_BUCKET, bucket)
            place = self._write(name, whole.repartition(F.col(_BUCKET)), [_BUCKET])
            entries += self._buckets(place, sorted(touched), of)
        self.tables[name] = entries
        return changed.drop(_BUCKET)

    def _buckets(self, place: str, numbers: Sequence[int], of: int) -> list[dict]:
        """Entries of the buckets that were written at a place; one without rows has no folder."""
        folders = {n: f"{place}/{_BUCKET}={n}" for n in numbers}
        return [{"at": self.version, "rows": folder, "bucket": n, "of": of} for n, folder in folders.items() if self.store._fs.exists(self.store._path(folder))]

    def read(self, name: str, schema: str | StructType) -> DataFrame:
        """The table as it will be."""
        return self.store._rows(self.tables.get(name, []), schema)

    def compact(self, name: str, schema: str, parts: int = PARTS) -> None:
        """Write the table anew if it has more than so many parts and deletions."""
        if len(self.tables.get(name, [])) > parts:
            whole = self._write(f"{name}.whole", self.read(name, schema))
            self.tables[name] = [{"at": self.version, "rows": whole}]

    def commit(self) -> int:
        stream = self.store._fs.create(self.store._path(f"{_folder(self.version)}/{MARKER}"))
        stream.write(json.dumps(self.tables).encode())
        stream.close()
        self.drop_spools()
        return self.version


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new put in place of those with equal keys; new must have one row per key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


_DIGEST = ("__d1", "__d2")


def _digest(columns: Sequence[str]) -> dict[str, Column]:
    """Two numbers of 64 bits that tell rows apart; Spark's hashes pass over nulls, so that these are hashed beside the values."""
    rows = [F.col(c) for c in columns]
    nulls = [c.isNull() for c in rows]
    return dict(zip(_DIGEST, (F.xxhash64(*rows, *nulls), F.xxhash64(F.lit(1), *nulls, *reversed(rows))), strict=True))


def _digests(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[x.alias(n) for n, x in _digest(columns).items()])


def assert_unique(df: DataFrame, key: list[str]) -> None:
    """Raise if two rows share a key. Hashes of the keys are counted, and keys themselves only where two have one hash."""
    number = F.xxhash64(*key).alias("__h")
    hashes = df.select(number).repartition("__h").groupBy("__h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__h")
    if hashes.isEmpty():
        return
    twice = df.select(*key, number).join(hashes, "__h", "left_semi").groupBy(*key).count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"{key} is not unique: {twice}")
