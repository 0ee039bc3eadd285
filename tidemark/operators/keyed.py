"""Keyed tables in versions: insert once and upsert by the files that may hold a key.

Rows lie in Parquet files by a hash of their key (``bucket``), a folder for each batch. A version is a small
manifest that names the live files; writing a batch adds files and then publishes the next manifest under the next
number, in one rename. Until then, and if the job dies before it, readers see the version before.

Each file has a Bloom filter of its keys, kept as rows: a word of 64 bits for each hash slot. A key
asks one word of each file of its bucket, which is a join on bucket and slot; only files with all of a key's bits set are
opened. A filter never denies a key it has, so nothing is stored twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut

BUCKETS = 64
BITS_PER_KEY = 16  # of the filter: about one key in a hundred opens a file for nothing
PROBES = 5  # bits of a key in its word
BUCKET = "_bucket"


class VersionConflict(RuntimeError):
    """Another writer has published the version this one meant to."""


@dataclass(frozen=True)
class Batch:
    """Live files of one batch: its folder and, for each bucket, the words of the bucket's filter."""

    folder: str
    words: dict[int, int]


@dataclass(frozen=True)
class Manifest:
    number: int
    keys: tuple[str, ...]
    buckets: int = BUCKETS
    batches: tuple[Batch, ...] = ()

    def to_json(self) -> str:
        return json.dumps({
            "keys": self.keys, "buckets": self.buckets,
            "batches": [{"folder": b.folder, "words": {str(k): n for k, n in b.words.items()}} for b in self.batches]})

    @staticmethod
    def from_json(number: int, text: str) -> Manifest:
        told = json.loads(text)
        return Manifest(number, tuple(told["keys"]), told["buckets"], tuple(
            Batch(b["folder"], {int(k): n for k, n in b["words"].items()}) for b in told["batches"]))


@dataclass(frozen=True)
class Change:
    """What a write did: the version it published (or found, if there was nothing to write) and the files it read."""

    version: int
    files_read: list[str] = field(default_factory=list)
    rows: DataFrame | None = None


class KeyedTable:
    """A stored table whose rows have a unique key; a null in a key column is a value like any other."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.buckets = tuple(keys), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path(self.path).getFileSystem(conf)
        where = self._path(self.path).makeQualified(self._files.getUri(), self._files.getWorkingDirectory())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    # --- versions ---

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/_versions")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, version: int | None = None) -> Manifest:
        """The latest version, or the given one; a table without any is empty at version 0."""
        known = self.versions()
        if version is None and not known:
            return Manifest(0, self.keys, self.buckets)
        number = known[-1] if version is None else version
        text = self.spark.read.text(f"{self.path}/_versions/{number:012d}.json", wholetext=True).first()[0]
        return Manifest.from_json(number, text)

    def _publish(self, manifest: Manifest) -> None:
        """The rename is the commit: it fails if the number is taken."""
        draft = self._path(f"{self.path}/_versions/.{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        out.write(bytearray(manifest.to_json().encode()))
        out.close()
        try:
            self._context.rename(draft, self._path(f"{self.path}/_versions/{manifest.number:012d}.json"), self._no_options)
        except Exception as taken:
            self._files.delete(draft, False)
            if manifest.number in self.versions():
                raise VersionConflict(f"version {manifest.number} of {self.path} is there already") from taken
            raise

    # --- reading ---

    def _file(self, folder: str, bucket: int) -> str:
        return f"{self.path}/{folder}/{BUCKET}={bucket}"

    def _read(self, files: Sequence[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*files)

    def read(self, version: int | None = None) -> DataFrame:
        manifest = self.manifest(version)
        return self._read([self._file(b.folder, k) for b in manifest.batches for k in b.words])

    # --- filters ---

    def _hashed(self, rows: DataFrame, buckets: int) -> DataFrame:
        # the key as JSON: nulls and neighbouring strings stay apart
        key = F.to_json(F.struct(*self.keys), {"ignoreNullFields": "false"})
        slot, bits = F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))
        return rows.withColumns({BUCKET: F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"), "_slot": slot, "_mask": _mask(bits)})

    def _may_hold(self, hashed: DataFrame, manifest: Manifest) -> list[tuple[str, int]]:
        """Folder and bucket of the live files whose filter has a key of ``hashed``; no more than there are files."""
        asked = {r[0] for r in hashed.select(BUCKET).distinct().collect()}
        live = [(b.folder, k, n) for b in manifest.batches for k, n in b.words.items() if k in asked]
        if not live:
            return []
        files = self.spark.createDataFrame(live, f"folder string, {BUCKET} int, words long")
        probes = hashed.select(BUCKET, "_slot", "_mask").join(F.broadcast(files) if len(live) <= 10_000 else files, BUCKET).select(
            "folder", BUCKET, F.pmod("_slot", "words").alias("word"), "_mask").distinct()
        paths = [f"{self.path}/_filters/folder={folder}/{BUCKET}={k}" for folder, k, _ in live]
        filters = self.spark.read.schema(f"folder string, {BUCKET} int, word long, bits long").option(
            "basePath", f"{self.path}/_filters").parquet(*paths)
        met = probes.join(filters, ["folder", BUCKET, "word"]).where(F.col("bits").bitwiseAND(F.col("_mask")) == F.col("_mask"))
        return sorted((r[0], r[1]) for r in met.select("folder", BUCKET).distinct().collect())

    def _write(self, rows: DataFrame, buckets: int) -> Batch:
        """Store rows and their filters as a new folder that no version names yet; types must fit the schema."""
        rows = rows.to(self._read([]).schema)
        folder = f"batch={uuid.uuid4().hex}"
        where = f"{self.path}/{folder}"
        self._hashed(rows, buckets).drop("_slot", "_mask").repartition(BUCKET).write.partitionBy(BUCKET).parquet(where)
        stored = self._hashed(self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(where).select(*self.keys), buckets)
        counts = {r[0]: r[1] for r in stored.groupBy(BUCKET).count().collect()}  # one row a bucket
        words = {k: n * BITS_PER_KEY // 64 + 1 for k, n in counts.items()}
        if words:
            sizes = self.spark.createDataFrame(list(words.items()), f"{BUCKET} int, words long")
            stored.join(sizes, BUCKET).groupBy(BUCKET, F.pmod("_slot", "words").alias("word")).agg(
                F.bit_or("_mask").alias("bits")).repartition(BUCKET).write.partitionBy(BUCKET).parquet(
                f"{self.path}/_filters/folder={folder}")
        return Batch(folder, words)

    # --- writing ---

    def insert_once(self, incoming: DataFrame) -> Change:
        """Add the rows whose key is not stored, one of each key; running it again adds nothing.

        Only files that may hold one of the keys are read, and of those only the key columns.
        """
        manifest = self.manifest()
        rows = cut(self._hashed(incoming.select(*self._columns()).dropDuplicates(list(self.keys)), manifest.buckets))
        files = [self._file(*at) for at in self._may_hold(rows, manifest)]
        fresh = rows.drop(BUCKET, "_slot", "_mask")
        if files:
            fresh = _without_keys(fresh, self._read(files), self.keys)
        batch = self._write(fresh, manifest.buckets)
        if not batch.words:
            return Change(manifest.number, files, self._read([]))
        after = replace(manifest, number=manifest.number + 1, batches=(*manifest.batches, batch))
        self._publish(after)
        return Change(after.number, files, self._read([self._file(batch.folder, k) for k in batch.words]))

    def upsert(self, updates: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> Change:
        """Replace the rows that have the key of an update and add the other updates; at most one update a key.

        Files that may hold an updated key are rewritten, all others stay. ``combine`` makes the new rows of those
        files out of their rows and the updates; by default updates win.
        """
        manifest = self.manifest()
        updates = cut(updates)
        met = self._may_hold(self._hashed(updates.select(*self.keys), manifest.buckets), manifest)
        files = [self._file(*at) for at in met]
        stored = self._read(files)
        if combine is None:
            merged = _without_keys(stored, updates, self.keys).unionByName(updates.select(*self._columns()))
        else:
            merged = combine(stored, updates)
        return self._replace(manifest, merged, met, files)

    def compact(self, most: int = 8) -> Change:
        """Put the files of every bucket that has more than ``most`` into one."""
        manifest = self.manifest()
        live = [(b.folder, k) for b in manifest.batches for k in b.words]
        often = {k for _, k in live if sum(1 for _, j in live if j == k) > most}
        met = [at for at in live if at[1] in often]
        files = [self._file(*at) for at in met]
        return self._replace(manifest, self._read(files), met, files) if met else Change(manifest.number)

    def _replace(self, manifest: Manifest, rows: DataFrame, old: Sequence[tuple[str, int]], files: list[str]) -> Change:
        batch = self._write(rows.select(*self._columns()), manifest.buckets)
        gone = set(old)
        kept = [Batch(b.folder, {k: n for k, n in b.words.items() if (b.folder, k) not in gone}) for b in manifest.batches]
        live = tuple(b for b in (*kept, batch) if b.words)
        after = replace(manifest, number=manifest.number + 1, batches=live)
        self._publish(after)
        return Change(after.number, files, self._read([self._file(batch.folder, k) for k in batch.words]))

    def vacuum(self, keep: int = 1) -> None:
        """Remove all but the last versions, and the folders that none of them names.

        For when no writer is at work: a batch that is not published yet would go too.
        """
        known = self.versions()
        stay = {b.folder for v in known[-keep:] for b in self.manifest(v).batches}
        for v in known[:-keep]:
            self._files.delete(self._path(f"{self.path}/_versions/{v:012d}.json"), False)
        for status in self._files.listStatus(self._path(self.path)):
            name = status.getPath().getName()
            if name.startswith("batch=") and name not in stay:
                self._files.delete(status.getPath(), True)
                self._files.delete(self._path(f"{self.path}/_filters/folder={name}"), True)

    def _columns(self) -> list[str]:
        return self._read([]).columns


def _mask(bits: Column) -> Column:
    """``PROBES`` bits of a word, each chosen by six bits of a hash."""
    out = F.lit(0).cast("long")
    for k in range(PROBES):
        six = F.shiftright(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), six))
    return out


def _without_keys(rows: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key is not among the others'; nulls are equal."""
    named = others.select(*[F.col(k).alias(f"_other_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_other_{k}"))
    return rows.join(named, same, "left_anti")


def is_keyed(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_versions")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
