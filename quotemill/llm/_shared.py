"""What several operators of this subpackage share: work tables, hashing of words, Arrow helpers."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows of one Arrow batch: long texts stay small beside an executor's memory.
ARROW_ROWS = 500


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Smaller Arrow batches than Spark's 10,000 rows, since whole texts travel in them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    return spark


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-quotemill-")


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of this process where none is named and all runs on this machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or _own_dir()


def materialize(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there, lost executors re-read."""
    spark = session_of(df)
    path = f"{work_dir(spark)}/quotemill/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Up to so many bytes of fixed-width rows are broadcast; beyond that they are joined by a shuffle.
SMALL_BYTES = 8_000_000


def small(rows: DataFrame, width: int = 8) -> DataFrame:
    """rows (of `width` bytes each, numbers only) with a broadcast hint if there are few enough."""
    return F.broadcast(rows) if rows.count() * width <= SMALL_BYTES else rows


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose doc_id isn't in ids(doc_id); rows without doc_id stay."""
    ids = materialize(ids.where("doc_id is not null").distinct())
    return docs.join(small(ids), "doc_id", "left_anti").select(*docs.columns)


def bucket_of(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % F.lit(modulus)


def crc_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of ASCII text, bit by bit."""
    return f"""xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))))"""


def columns(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns, cast; a column that df lacks is null. Whatever else df holds plays no part."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*((F.col(f"`{have[c]}`") if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()))


def numbered(rows: DataFrame, tree: str, *order: str, written: bool = True) -> DataFrame:
    """rows with `place`, from 0, in the order of the columns `order` within its tree (a string column without nulls), and `total`,
    the tree's number of rows; nulls first.

    Rows are dealt out by ranges of (tree, order) and counted within their task; what the tasks before hold is added, so no
    tree, however large, comes together in one task. Among equal rows the order is any. `written`: are the rows written first, since
    the ranges are drawn from a pass of their own? Else that pass makes them a second time.
    """
    rows = materialize(rows) if written else rows
    schema = T.StructType([*rows.schema.fields, T.StructField("_slice", T.IntegerType()), T.StructField("_nth", T.LongType())])

    def count(batches):
        here, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            nth = np.empty(batch.num_rows, np.int64)
            for i, key in enumerate(batch.column(tree).to_pylist()):
                last, n = key, n + 1 if key == last else 0
                nth[i] = n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(nth), here, np.int32)), pa.array(nth)], names=schema.names)

    dealt = materialize(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).mapInArrow(count, schema))
    held = dealt.groupBy(tree, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    slices = Window.partitionBy(tree).orderBy("_slice")
    before = F.coalesce(F.sum("_n").over(slices.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.select(tree, "_slice", before.alias("_before"), F.sum("_n").over(Window.partitionBy(tree)).alias("total"))
    return dealt.join(starts, [tree, "_slice"]).select(*rows.columns, (F.col("_before") + F.col("_nth")).alias("place"), "total")


def per_batch(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with outputs given as dicts of columns; `work` sees all the batches of a partition."""
    out = to_arrow(schema)

    def run(batches):
        for found in work(batches):
            yield pa.RecordBatch.from_arrays([pa.array(found[f.name], type=f.type, from_pandas=False) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def to_arrow(schema: str) -> pa.Schema:
    kinds = {
        T.LongType: pa.int64(),
        T.IntegerType: pa.int32(),
        T.DoubleType: pa.float64(),
        T.StringType: pa.string(),
        T.BinaryType: pa.binary(),
        T.BooleanType: pa.bool_(),
    }

    def kind(t):
        if isinstance(t, T.ArrayType):
            return pa.list_(kind(t.elementType))
        if isinstance(t, T.StructType):
            return pa.struct([pa.field(f.name, kind(f.dataType)) for f in t])
        return kinds[type(t)]

    return pa.schema([pa.field(f.name, kind(f.dataType)) for f in T._parse_datatype_string(schema)])


def lists(parts: list[np.ndarray], dtype) -> pa.Array:
    """A list column out of one numpy array per row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts).astype(dtype, copy=False) if parts else np.empty(0, dtype)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


# ---- words as 64-bit numbers ---------------------------------------------------------------------------------------

_ODD = 0x9E3779B97F4A7C15
_BLOCK = 1 << 16
_MASK = (1 << 64) - 1


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, powers of an odd base, and powers of its inverse, all modulo 2**64."""
    byte = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64)
    byte[[9, 10, 11, 12, 13, 32]] = 0
    base, inverse = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)

    def powers(x):
        out = np.ones(_BLOCK, np.uint64)
        out[1:] = np.uint64(x)
        return np.multiply.accumulate(out)

    return byte, powers(base), powers(inverse)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of x over all 64 bits, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_block(b: np.ndarray) -> np.ndarray:
    byte, up, down = _tables()
    word = byte[b]  # 0 at separators
    is_word = word != 0
    start = np.flatnonzero(is_word[1:] > is_word[:-1]) + 1
    if is_word[0]:
        start = np.concatenate(([0], start))
    if not len(start):
        return np.empty(0, np.uint64)
    word *= up[: len(b)]
    return mix(np.add.reduceat(word, start) * down[start])


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of a text, A-Z lower-cased, in their order.

    Null and empty texts have no words. Long texts are cut between words, so memory stays a small multiple of the text.
    """
    if not text:
        return np.empty(0, np.uint64)
    data = text.encode("utf-8", "surrogatepass").lower()
    if len(data) <= _BLOCK:
        return _hash_block(np.frombuffer(data, np.uint8))
    parts, at = [], 0
    while at < len(data):
        end = min(at + _BLOCK, len(data))
        if end < len(data):
            cut = max(data.rfind(s, at, end) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < at:  # one word fills the block
                ends = [x for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := data.find(s, end)) >= 0]
                cut = min(ends, default=len(data))
                parts.append(np.array([_long_word(data[at:cut])], np.uint64))
                at = cut
                continue
            end = max(cut, at + 1)
        parts.append(_hash_block(np.frombuffer(data, np.uint8, end - at, at)))
        at = end
    return np.concatenate(parts)


def _long_word(word: bytes) -> int:
    h = 0
    for at in range(0, len(word), _BLOCK):
        h = (h * _ODD + int(_hash_block(np.frombuffer(word[at : at + _BLOCK], np.uint8))[0])) & _MASK
    return h


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each position over aligned arrays of hashes (an n-gram's words)."""
    h = parts[0]
    for p in parts[1:]:
        h = mix(h * np.uint64(_ODD) + p)
    return h


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
