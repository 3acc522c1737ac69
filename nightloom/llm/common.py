"""What the operators of this subpackage share: tables, shared storage and vectorised tokens.

Words are runs of bytes that are no separators, found over a whole Arrow batch at a time. A
word is carried as a 64-bit hash of its (lower-cased) UTF-8 bytes.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are tokenised at once; a longer document is a piece of its own.
PIECE_BYTES = 1 << 20
#: Arrow batches of about so many bytes go to Python where an operator asks for small ones; a longer row
#: is a batch of its own.
BATCH_BYTES = 2 << 20
#: Spark's buffer for each broadcast, of which every stage has one: at its 4 MB, a plan of many small stages fills the
#: driver's heap with objects of several G1 regions, which make the heap grow; under half a region they are plain garbage.
BROADCAST_BLOCK = "256k"
SPACE_CLASS = r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_key() -> Column:
    """A 64-bit hash of a row's text and doc_id. Joins on it also compare doc_id, so that two texts
    are confused only if they share the doc_id and the hash."""
    return F.xxhash64(F.col("text").cast("string"), F.col("doc_id").cast("long"))


def whole_rows(docs: DataFrame) -> DataFrame:
    """doc (all columns as they are), doc_id, text and row: columns of docs can't clash with an operator's own."""
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.select(F.struct(*columns).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("row"))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """The join of (doc_id, row) with (doc_id_, row_)."""
    return (left["row"] == right["row_"]) & left["doc_id"].eqNullSafe(right["doc_id_"])


def free_name(columns: list[str], name: str) -> str:
    """The name, with underscores after it as long as a column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


_PATHS: set[str] = set()


def _delete(path: str) -> None:
    sc = SparkContext._active_spark_context
    if sc is not None and sc._jsc is not None:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def _delete_all() -> None:
    while _PATHS:
        _delete(_PATHS.pop())


atexit.register(_delete_all)


@contextmanager
def small_batches(spark: SparkSession, size: int | None):
    """Queries that run meanwhile send Python Arrow batches of about so many bytes, unless the session
    sets a size of its own. A batch is held by the JVM, outside its heap, and by the worker, at least once each."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    ours = size is not None and spark.conf.get(key, None) is None
    if ours:
        spark.conf.set(key, size)
    try:
        yield
    finally:
        if ours:
            spark.conf.unset(key)


def small_broadcasts(spark: SparkSession) -> None:
    """From now on broadcasts are laid out in blocks of BROADCAST_BLOCK, unless the application sets a size of its own.

    Spark reads the size for each broadcast from the running context's own settings. Nothing is bounded by it:
    a larger broadcast has more blocks.
    """
    conf = spark.sparkContext._jsc.sc().conf()
    if not conf.contains("spark.broadcast.blockSize"):
        conf.set("spark.broadcast.blockSize", BROADCAST_BLOCK)


def slices(batch: pa.RecordBatch, size: int = BATCH_BYTES):
    """The batch in pieces of about so many bytes, without a copy."""
    n = max(1, batch.num_rows * size // max(1, batch.nbytes))
    for i in range(0, max(1, batch.num_rows), n):
        yield batch.slice(i, n)


class Workspace:
    """A folder of its own under spark.checkpoint.dir, for tables that cut a plan's lineage.

    Tables are written as Parquet to storage that all executors share, so that a lost executor
    loses none of them. Results are read from them lazily, so a folder is deleted when the driver ends.
    With ``batch_bytes``, Python passes on the way to a table get Arrow batches of about that size.
    """

    def __init__(self, spark: SparkSession, name: str, batch_bytes: int | None = None):
        self.batch_bytes = batch_bytes
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder")
            base = os.path.join(tempfile.gettempdir(), "checkpoints")
        self.spark, self.path = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        _PATHS.add(self.path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        with small_batches(self.spark, self.batch_bytes):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(f"{self.path}/{name}")


#: Keys with over a thousandth of the rows are split: there are HOT of them at most, whatever the data.
HOT, LEAST_SHARE = 1000, 4096


def salted(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left.join(right, keys, how) for an inner, left or left_semi join with a written left side: the left
    rows of a hot key are dealt over several tasks, and the right rows with that key go to each.

    Only the hot keys (at most HOT, by their share of the rows) are broadcast.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("hot_n"))
    share = max(LEAST_SHARE, left.count() // HOT)
    hot = counts.where(F.col("hot_n") > share).select(*keys, F.ceil(F.col("hot_n") / share).cast("int").alias("hot_n"))
    found = hot.collect()
    if not found:
        return left.join(right, keys, how)
    hot = left.sparkSession.createDataFrame(found, hot.schema)
    many = F.coalesce("hot_n", F.lit(1))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("salt", F.pmod(F.xxhash64(*left.columns), many).cast("int")).drop("hot_n")
    copied = right.join(F.broadcast(hot), keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("hot_n")
    return dealt.join(copied, [*keys, "salt"], how).drop("salt")


def numbered(df: DataFrame, order: list, work: Workspace, name: str) -> DataFrame:
    """The rows with their number (from 0) in an order, without a task that sees them all."""
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    laid = work.keep(laid, name)
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["part"], r["n"]) for r in laid.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for at, n in sizes:
        offsets.append((at, total))
        total += n
    offsets = df.sparkSession.createDataFrame(offsets, "part long, before long")
    return laid.join(F.broadcast(offsets), part == F.col("part")).withColumn("number", F.col("before") + within).drop("place", "part", "before")


def maybe_broadcast(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A broadcast hint for a written table, if a count finds at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def word_count(text="text"):
    """Number of whitespace-separated words, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(SPACE_CLASS + "+")), F.lit(0)).cast("long")


def crc_mod(doc_id, n: int):
    """crc32 of doc_id as text, modulo n; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def bounded_sample(rows: DataFrame, n: int, *keep: str) -> DataFrame:
    """The n rows whose doc_id hashes least: the same ones in every run."""
    return rows.orderBy(F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string")), *keep).limit(n)


def few_tasks(df: DataFrame) -> DataFrame:
    """At most four tasks per core, without a shuffle: for small tables."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def sized_tasks(df: DataFrame, size: int, each: int) -> DataFrame:
    """Tasks of about `each` of `size` units, without a shuffle, and one for every core at least: for
    passes whose every task returns a table of fixed size. A task's work doesn't grow with the input."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // each)))


# ---------------------------------------------------------------------------- vectorised tokens


def byte_classes(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words, and each byte's value after lower-casing A-Z, plus 1."""
    code = np.arange(256)
    fold = np.where((code >= 65) & (code <= 90), code + 32, code)
    if kind == "space":
        word = ~((code == 32) | ((code >= 9) & (code <= 13)))
    elif kind == "alnum":
        word = ((fold >= 48) & (fold <= 57)) | ((fold >= 97) & (fold <= 122)) | (code >= 128)
    else:
        raise ValueError(kind)
    return word, (fold + 1).astype(np.uint64)


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    out = []
    for base in (_BASE, _BASE_INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offs


def tokens(column, kind: str = "space", fold: bool = True, piece: int = PIECE_BYTES):
    """Yields (first row, word bounds by row, hashes, first byte, end byte, hash_of) by pieces of rows.

    bounds[i]:bounds[i + 1] are the words of row first + i; hash_of(start, end) hashes other spans
    of the piece's bytes in the same way.
    """
    buf, offs = text_bytes(column)
    n, row = len(offs) - 1, 0
    word_table, fold_table = byte_classes(kind)
    value_table = fold_table if fold else np.arange(1, 257).astype(np.uint64)
    longest = int(np.diff(offs).max()) if n else 0
    power, inverse = powers(max(1, min(int(offs[-1] - offs[0]), max(piece, longest)) + 1))
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offs, offs[row] + piece, "right")) - 1)
        part = buf[offs[row] : offs[stop]]
        local = offs[row : stop + 1] - offs[row]
        size = len(part)
        if not size:
            empty = np.zeros(0, np.int64)
            yield row, np.zeros(stop - row + 1, np.int64), np.zeros(0, np.uint64), empty, empty, lambda s, e: np.zeros(0, np.uint64)
            row = stop
            continue
        is_word = word_table[part]
        cut = np.zeros(size + 1, bool)
        cut[local] = True
        before = np.empty(size, bool)
        before[0] = False
        before[1:] = is_word[:-1]
        start = np.flatnonzero(is_word & (~before | cut[:size]))
        after = np.empty(size, bool)
        after[-1] = False
        after[:-1] = is_word[1:]
        end = np.flatnonzero(is_word & (~after | cut[1:])) + 1
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(value_table[part] * power[:size], out=sums[1:])

        def hash_of(s, e, sums=sums, inverse=inverse):
            return mix(((sums[e] - sums[s]) * inverse[s]) ^ ((e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

        yield row, np.searchsorted(start, local), hash_of(start, end), start, end, hash_of
        row = stop


def chain(*parts: np.ndarray) -> np.ndarray:
    """An order-sensitive hash of several 64-bit columns."""
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + p + np.uint64(0x9E3779B97F4A7C15))
    return out


def word_hash(word: bytes) -> int:
    """The hash that tokens() gives to one (already lower-cased) word."""
    h = 0
    for i, b in enumerate(word):
        h += (b + 1) * pow(_BASE, i, 1 << 64)
    value = np.array([h % (1 << 64)], np.uint64)
    return int(mix(value ^ (np.array([len(word)], np.uint64) * np.uint64(0xD6E8FEB86659FD93)))[0])
