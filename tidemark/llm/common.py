"""Plumbing shared by the corpus operators: scratch tables, tolerant column access, bounded Bloom filters."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words and that text equality ignores: space and \t \n \v \f \r.
SPACE_BYTES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_scratch: list[tempfile.TemporaryDirectory] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary folder only on a local master."""
    conf = spark.sparkContext.getConf()
    if root := conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    if not _local_scratch:
        _local_scratch.append(tempfile.TemporaryDirectory(prefix="tidemark-"))
        atexit.register(_local_scratch[0].cleanup)
    return "file://" + _local_scratch[0].name


class Scratch:
    """Written tables of one operator call: `put` cuts lineage, `drop` frees what the result no longer reads."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.root, self.paths = spark, f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}", {}
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)  # what the result still reads

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path, conf = f"{self.root}/{name}", self.spark.conf
        was = conf.get(SHUFFLE_CLEANUP, "false")
        conf.set(SHUFFLE_CLEANUP, "true")  # what was shuffled for this table is not needed once it is written
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(SHUFFLE_CLEANUP, was)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def sweep(self) -> None:
        """Lets Spark delete the shuffle files of lineage that a written table has cut; else they stay until the driver
        happens to collect its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, so that extra columns of the input never clash with an operator's own."""
    return df.select(*[df[n] for n in names])


def text_or_empty(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    return df.select(*[df[k] for k in keys], F.coalesce(df[text], F.lit("")).alias("text"))


def byte_parts(df: DataFrame, target: int, weight: Column) -> int:
    """Partitions so that each holds about `target` of the summed weight, at least the session's own number."""
    total = df.agg(F.sum(weight)).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // target))


def strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


class Bloom:
    """A Bloom filter of 64 slices over 64-bit keys, at most 2**MAX_LOG bits (64 MB) whatever the input.

    Beyond that size it fills up and prunes less; it never loses a key. Each slice is built in one partition
    from the keys that fall to it, so no bitmap is merged on the driver, which only lays 64 slices side by side.
    """

    SLICES, MIN_LOG, MAX_LOG = 64, 16, 29

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.mask = np.uint64(bits.shape[1] * 8 - 1)

    @classmethod
    def log_bits(cls, keys: int) -> int:
        return min(cls.MAX_LOG, max(cls.MIN_LOG, int(np.ceil(np.log2(max(1, keys) * 12)))))

    @classmethod
    def tasks(cls, log_bits: int) -> int:
        """Partitions that build a filter: one for each 2**21 bits, one for each slice at most."""
        return min(cls.SLICES, 1 << max(0, log_bits - 21))

    @staticmethod
    def _places(keys: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        from .kernels import mix

        x = mix(keys ^ np.uint64(0x5851F42D4C957F2D))
        return x & mask, (x >> np.uint64(32)) & mask

    @classmethod
    def build(cls, keys: DataFrame, count: int) -> "Bloom":
        """keys: one BIGINT column `key`; count: about how many."""
        log_bits, slices = cls.log_bits(count), cls.SLICES
        size = (1 << log_bits) // slices // 8

        def fill(batches):
            held: dict[int, np.ndarray] = {}
            mask = np.uint64(size * 8 - 1)
            for batch in batches:
                key = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                part = (key & np.uint64(slices - 1)).astype(np.int64)
                for s in np.unique(part):
                    bits = held.setdefault(int(s), np.zeros(size, np.uint8))
                    for place in cls._places(key[part == s], mask):
                        np.bitwise_or.at(bits, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
            if held:
                yield pa.RecordBatch.from_pydict({"slice": pa.array(list(held), pa.int32()), "bits": pa.array([b.tobytes() for b in held.values()], pa.binary())})

        parts = keys.select("key", F.pmod("key", F.lit(slices)).alias("slice")).repartition(cls.tasks(log_bits), "slice").select("key").mapInArrow(fill, "slice int, bits binary")
        bits = np.zeros((slices, size), np.uint8)
        for row in parts.collect():  # at most 64 MB
            bits[row.slice] |= np.frombuffer(row.bits, np.uint8)
        return cls(bits)

    def might_hold(self, keys: np.ndarray) -> np.ndarray:
        part, hit = (keys & np.uint64(self.SLICES - 1)).astype(np.int64), np.ones(len(keys), bool)
        for place in self._places(keys, self.mask):
            hit &= (self.bits[part, (place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return hit
