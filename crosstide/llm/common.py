"""What the operators share: input columns, written tables, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.shipping import ship

#: Upper-case ASCII to lower case, every other byte as it is.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets one of
    its own; a cluster is refused, since its machines don't share a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="crosstide-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: the lineage ends here and survives lost executors. `removed`
    deletes it; the last tables of an operator stay for as long as its result is read, since that is lazy."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out.written_at = path
    return out


def removed(*tables: DataFrame | None) -> None:
    """Deletes what `written` wrote for these; none may be read again."""
    for df in tables:
        if path := getattr(df, "written_at", None):
            jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


#: Of all rows, the share at which a key counts as hot: there are HOT such keys at most.
HOT = 1000


def join_keyed(rows: DataFrame, side: DataFrame, key: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """rows joined to side, which has a row for each key at most; how: inner or left. Rows of hot keys, a HOTth of all
    or more, stay where they are: side's HOT rows for them at most are broadcast. Other keys are joined by a shuffle;
    rows without a key take no part in it. total: the number of rows, where it is known."""
    total = rows.count() if total is None else total
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows of key"))
    hot = [r[0] for r in counts.where(F.col("rows of key") * HOT >= total).select(key).collect()] if total > 16 * HOT else []
    there = rows.where(F.col(key).isNotNull())
    if hot:
        is_hot = F.col(key).isin(hot)
        out = there.where(~is_hot).join(side.where(~is_hot), key, how).unionByName(there.where(is_hot).join(F.broadcast(side.where(is_hot)), key, how))
    else:
        out = there.join(side, key, how)
    return out if how == "inner" else out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def tidy(*caches: dict) -> None:
    """At a task's end: what the worker, which lives on, doesn't need any more."""
    for cache in caches:
        cache.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores: a small file is one task, whatever is done with its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() * 2 <= cores else df


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, null texts as empty ones."""
    ship(docs.sparkSession)
    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))


class WordHashes(dict):
    """64-bit hashes of byte strings, equal on every machine; emptied when it holds too many."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63))


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of a common 64-bit hash: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words, in order; fewer words: one of the whole sequence; none: none."""
    n = len(words)
    if n == 0:
        return words
    size = min(width, n)
    out = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        out += mixed(words[k : n - size + 1 + k] * _ODD[k % 5] + np.uint64(k))
    return mixed(out + np.uint64(size))


def schema_of(fields: Iterable[tuple[str, str]]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in fields)
