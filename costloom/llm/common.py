"""Shared helpers of the corpus operators: tokens, hash folds, durable tables."""

from __future__ import annotations

import ctypes
import functools
import re
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costloom.functions.tables import fresh_folder

#: Words are runs of anything but the ASCII white space characters.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key written as text, modulo ``n`` (null keys: crc32 of the empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def valid_text(text: Column) -> Column:
    """The text as all operators read it: each sequence of bytes that isn't valid UTF-8 is one U+FFFD or more, as Java has it."""
    return F.make_valid_utf8(text)


def refuse(carry: list[str], own: list[str]) -> None:
    """Carried columns may not bear a result's name, nor one name twice."""
    names = [c.lower() for c in carry]
    clash = sorted({c for c in names if c in {o.lower() for o in own} or names.count(c) > 1})
    if clash:
        raise ValueError(f"carried columns clash: {', '.join(clash)}")


def text_bytes(text) -> bytes:
    """The UTF-8 bytes of a text with A-Z lower-cased; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def ascii_words(text) -> list[bytes]:
    """Lower-cased (A-Z only) white-space words of a text."""
    return WORD.findall(text_bytes(text))


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path for one written table under the session's shared folder."""
    return fresh_folder(spark, what)


_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def written():
    """The list of the paths that :func:`durable` writes to inside the block, in this thread."""
    paths: list[str] = []
    token = _WRITTEN.set(paths)
    try:
        yield paths
    finally:
        _WRITTEN.reset(token)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Remove written tables that nothing will read again."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def durable(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """Write a table into the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a reread and not the whole job again. The table stays
    until :func:`drop_tables` is told to remove it.
    """
    path = fresh_path(df.sparkSession, what)
    paths = _WRITTEN.get()
    if paths is not None:
        paths.append(path)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_HELD: dict = {}


def held(key, make):
    """An object that a Python worker keeps between tasks; one at a time, as workers live through many stages."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def small_batches(spark: SparkSession, limit: int = 2_000_000) -> None:
    """Lower the session's bound on the bytes of an Arrow batch, so that long texts don't pile up in Python workers."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.match(r"\d+", spark.conf.get(name, None) or "")
    if held and int(held[0]) > limit:
        spark.conf.set(name, str(limit))


def with_text(docs: DataFrame, carry: list[str]) -> tuple[DataFrame, int]:
    """The carried columns and the text, and the text's position; a carried text isn't sent twice. The text is valid UTF-8 (:func:`valid_text`)."""
    small_batches(docs.sparkSession)
    docs = docs.withColumn("text", valid_text(F.col("text")))
    if "text" in carry:
        return docs.select(*carry), carry.index("text")
    return docs.select(*carry, F.col("text").alias("__text")), len(carry)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array, limit: int):
    """(start, stop, slice) runs of a column of texts of about ``limit`` bytes each; only one need be unpacked at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) + 1)
    lo = 0
    while lo < len(column):
        done = ends[lo - 1] if lo else 0
        hi = min(len(column), int(np.searchsorted(ends, done + limit)) + 1)
        yield lo, hi, column.slice(lo, hi - lo)
        lo = hi


def token_hashes(texts: list, pattern: re.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keyed hash and text number of every token of many texts (bytes or null), in order; A-Z count as a-z.

    A SipHash of the token's bytes, so that no family of texts collides by its form: two tokens share
    a hash with a chance of 2^-64.
    """
    found = [pattern.findall(t.lower()) if t else [] for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.empty(int(counts.sum()), object)
    flat[:] = list(chain.from_iterable(found))
    return mix64(hash_array(flat, categorize=False)), np.repeat(np.arange(len(found)), counts)


def give_back() -> None:
    """Return freed memory of Arrow's pool and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def frugal(run):
    """A function for ``mapInArrow`` that gives freed memory back when its task ends, as Python workers live through many stages."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped
