"""A keyed table in hash buckets: an upsert rewrites the buckets that it touches, and one manifest makes it count.

Layout of a store's folder: manifest/NNNNNNNNNN.json, one for each version, and data/commit=<id>/bucket=<k>/*.parquet. A
manifest names for each bucket the commit that holds it. An upsert reads the buckets that have new keys, writes them
under a commit id of its own, and then puts down the next manifest; all other buckets stay the files they are. What a
lost or aborted job wrote is in no manifest and is not read. Two writers who start from one version want the same next
manifest: the file system lets one of them create it, the other gets StoreChanged and starts anew. That needs a file
system that creates a file only if it is not there (HDFS, local folders); a manifest that is not whole does not count.

Keys are hashed, and unique within the store, so buckets are of like size; take so many that a bucket fits a task.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyforge.sources.files import hadoop


class StoreChanged(RuntimeError):
    """Another writer has put down the version that this one was about to."""


@dataclass
class Version:
    number: int
    keys: list[str]
    n_buckets: int
    schema: StructType
    #: bucket -> commit id
    buckets: dict[int, str]
    #: What the writer had to say about the commit.
    note: dict


class BucketStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- manifests

    def versions(self) -> list[int]:
        fs, path = hadoop(self.spark, f"{self.path}/manifest")
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(path) if s.getPath().getName().endswith(".json"))

    def version(self, number: int | None = None) -> Version | None:
        """A version, or the last whole one; None if there is none."""
        for n in [number] if number is not None else reversed(self.versions()):
            found = self._manifest(n)
            if found is not None:
                return found
        return None

    def _manifest(self, number: int) -> Version | None:
        fs, path = hadoop(self.spark, f"{self.path}/manifest/{number:010d}.json")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            m = json.loads(text)
        except ValueError:
            return None
        return Version(number, m["keys"], m["n_buckets"], StructType.fromJson(m["schema"]), {int(b): c for c, own in m["commits"].items() for b in own}, m["note"])

    def _put(self, number: int, keys: list[str], n_buckets: int, schema: StructType, buckets: dict[int, str], note: dict) -> None:
        commits: dict[str, list[int]] = {}
        for b, c in sorted(buckets.items()):
            commits.setdefault(c, []).append(b)
        text = json.dumps({"keys": keys, "n_buckets": n_buckets, "schema": json.loads(schema.json()), "commits": commits, "note": note})
        fs, path = hadoop(self.spark, f"{self.path}/manifest/{number:010d}.json")
        try:
            stream = fs.create(path, False)
        except Exception as e:
            if fs.exists(path):
                raise StoreChanged(f"version {number} of {self.path} is there already") from e
            raise
        stream.write(text.encode())
        stream.close()

    # ---- reading

    def create(self, keys: list[str], schema: StructType, n_buckets: int = 64) -> BucketStore:
        self._put(1, keys, n_buckets, schema, {}, {})
        return self

    def bucket_of(self, version: Version) -> Column:
        return F.pmod(F.xxhash64(*version.keys), F.lit(version.n_buckets)).cast("int")

    def read(self, version: Version | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version (the last one), or of some of its buckets; one scan over just their folders."""
        v = version or self.version()
        own = [f"{self.path}/data/commit={c}/bucket={b}" for b, c in sorted(v.buckets.items()) if buckets is None or b in buckets]
        if not own:
            return self.spark.createDataFrame([], v.schema)
        return self.spark.read.schema(v.schema).option("basePath", f"{self.path}/data").parquet(*own).select(*v.schema.names)

    def files(self, version: Version | None = None) -> dict[int, list[str]]:
        """The files of each bucket."""
        v, out = version or self.version(), {}
        for b, c in v.buckets.items():
            fs, path = hadoop(self.spark, f"{self.path}/data/commit={c}/bucket={b}")
            out[b] = sorted(s.getPath().toString() for s in fs.listStatus(path) if s.getPath().getName()[0] not in "._")
        return out

    # ---- writing

    def upsert(self, new: DataFrame, merge: Callable[[str], Column] | None = None, order: str | None = None, note: dict | None = None) -> Version:
        """Rows of new replace those with their keys, and others are added; returns the version that counts from now on.

        merge: for a column's name the value of a key that the store has, from the columns `old` and `new` (structs of the
        store's columns); by default new's. Of several new rows with one key the last by `order` counts, else the greatest.
        """
        v = self.version()
        names, keys = v.schema.names, v.keys
        cast = [F.col(f.name).cast(f.dataType).alias(f.name) for f in v.schema]
        fresh = new.select(self.bucket_of(v).alias("bucket"), *cast, (F.col(order) if order else F.lit(None).cast("int")).alias("_order"))
        # bounded by the number of buckets, which the manifest lists as well
        touched = {r.bucket for r in fresh.select("bucket").distinct().collect()}
        if not touched:
            return v
        row = F.struct(*names)
        there = self.read(v, touched).select(self.bucket_of(v).alias("bucket"), *keys, F.lit(False).alias("is_new"), F.lit(None).cast(fresh.schema["_order"].dataType).alias("_order"), row.alias("row"))
        every = there.unionByName(fresh.select("bucket", *keys, F.lit(True).alias("is_new"), "_order", row.alias("row")))
        # one shuffle, by bucket: the rows of a key meet in it, and it is written from it
        dealt = every.repartition(min(len(touched), max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) * 4)), "bucket")
        met = dealt.groupBy("bucket", *keys).agg(F.max(F.when(F.col("is_new"), F.struct("_order", "row"))).alias("n"), F.max(F.when(~F.col("is_new"), F.col("row"))).alias("old"))
        met = met.select("bucket", "old", F.col("n.row").alias("new"))
        value = lambda c: F.when(F.col("new").isNull(), F.col(f"old.{c}")).when(F.col("old").isNull(), F.col(f"new.{c}")).otherwise(merge(c) if merge and c not in keys else F.col(f"new.{c}"))
        commit = uuid.uuid4().hex
        met.select("bucket", *[value(c).alias(c) for c in names]).write.partitionBy("bucket").parquet(f"{self.path}/data/commit={commit}")
        self._put(v.number + 1, keys, v.n_buckets, v.schema, v.buckets | dict.fromkeys(touched, commit), note or {})
        return self.version(v.number + 1)

    def vacuum(self, keep: int = 1, young_ms: int = 86_400_000) -> int:
        """Deletes the manifests before the last `keep`, and the commits that only they name; the commits deleted. Commits in no
        manifest go too, unless they are about as young as the newest: a writer may be at work on them."""
        manifests = {n: self._manifest(n) for n in self.versions()}
        last = sorted(n for n, v in manifests.items() if v)[-keep:]
        wanted = {c for n in last for c in manifests[n].buckets.values()}
        named = {c for v in manifests.values() if v for c in v.buckets.values()}
        for n in manifests:
            if n < min(last, default=0):
                fs, path = hadoop(self.spark, f"{self.path}/manifest/{n:010d}.json")
                fs.delete(path, False)
        fs, data = hadoop(self.spark, f"{self.path}/data")
        held = list(fs.listStatus(data)) if fs.exists(data) else []
        newest, gone = max((s.getModificationTime() for s in held), default=0), 0
        for s in held:
            name = s.getPath().getName().removeprefix("commit=")
            if name not in wanted and (name in named or newest - s.getModificationTime() >= young_ms):
                gone += bool(fs.delete(s.getPath(), True))
        return gone


def set_columns(*columns: str) -> Callable[[str], Column]:
    """A merge that sets these columns where the key is there, and leaves the others as they are."""
    return lambda c: F.col(f"new.{c}") if c in columns else F.col(f"old.{c}")
