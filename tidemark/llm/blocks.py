"""Chunks of whole documents, and an exchange of compact sorted keys between them.

A chunk is a range of document ids, or a part of them by hash, with about ``target`` bytes of text, so it fits a task. Chunks and buckets
are equally many, so the number of blobs is the square of that; to keep a blob at a kilobyte or more, chunks grow
as the square root of the input, from 4 MiB up to 16 GB of text to 32 MiB from 1 TB on, and no further: what a task needs has
a bound, and beyond that blobs get shorter, at worst one for each key, as in any shuffle. Operators that must know which of their many hashes occur elsewhere don't shuffle a row
for each: a chunk sorts its distinct keys and sends one delta-coded blob to each bucket of the key
space; a bucket compares the blobs and answers with one small flag per key, in the order it came. A key
that a third of all documents hold is sent once by each chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import workspace

TARGET, MOST = 4 << 20, 32 << 20
#: Ranges of ids that are found by percentiles; more chunks are equal parts of these.
_RANGES = 20_000


def _parts(df: DataFrame, text: str, target: int) -> int:
    workspace.small_batches(df.sparkSession)
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, math.ceil(total / max(target, min(math.isqrt(total << 10), MOST))))


def scattered(df: DataFrame, by: list[str], text: str, target: int = TARGET, name: str = "chunk") -> tuple[DataFrame, int]:
    """df with an int column ``name``: chunks by a hash of the columns ``by``; and how many there can be. Rows that are equal in all of them share a chunk."""
    parts = _parts(df, text, target)
    return df.withColumn(name, F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")), parts


def chunked(df: DataFrame, by: str, text: str, target: int = TARGET, name: str = "chunk", split: str | None = None) -> tuple[DataFrame, int]:
    """df with an int column ``name``: ranges of ``by`` in ascending order; and how many there can be.

    Null comes first. Rows with equal ``by`` share a chunk; with ``split``, a column of 64-bit hashes, those of an id that fills
    several chunks are dealt out to them in ascending order of it.
    """
    rank = F.coalesce(F.col(by).cast("long"), F.lit(-(1 << 63)))
    parts, bounds = _parts(df, text, target), np.array([], np.int64)
    fine = -(-parts // _RANGES)
    if parts > 1:
        ranges = -(-parts // fine)
        found = df.agg(F.percentile_approx(rank, [i / ranges for i in range(1, ranges)], max(10_000, 4 * ranges)).alias("at"), F.min(rank).alias("least"), F.max(rank).alias("most")).first()
        bounds = np.array(found["at"] or [], np.int64)
        if not split:
            bounds = np.unique(bounds)
        least, most = found["least"], found["most"]
    if not len(bounds):
        return df.withColumn(name, F.lit(0)), 1
    edges = np.concatenate(([least - 1 if least > -(1 << 63) else least], bounds, [most])).astype(np.float64)

    @F.pandas_udf("int")
    def place(x: pd.Series, h: pd.Series) -> pd.Series:
        x = x.to_numpy()
        at = np.searchsorted(bounds, x, side="left")
        within = (x.astype(np.float64) - edges[at]) / np.maximum(edges[at + 1] - edges[at], 1.0)
        point = at * fine + np.clip(np.ceil(within * fine) - 1, 0, fine - 1)
        if split:
            spare = np.searchsorted(bounds, x, side="right") - at - 1
            share = np.minimum((h.to_numpy().astype(np.float64) + 2.0**63) / 2.0**64, 1 - 1e-9)
            point = np.where(spare > 0, (at + 1) * fine + np.floor(share * np.maximum(spare, 1) * fine), point)
        return pd.Series(point.astype(np.int32))

    return df.withColumn(name, place(rank, F.col(split) if split else F.lit(0).cast("long"))), (len(bounds) + 1) * fine


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads each bit of a hash over all of it."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting (np.unique hashes, which takes several times as long on random keys)."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, so that a rolling hash is two prefix sums apart."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            grow = lambda b: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))), dtype=np.uint64)
            self.up, self.down = grow(self.base), grow(self.inverse)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums c with c[j] - c[i] = base**i times the Rabin-Karp hash of values[i:j]."""
    up, _ = POWERS.upto(len(values) + 1)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))


def ranges(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The Rabin-Karp hash of each [start, end), given prefix()."""
    _, down = POWERS.upto(len(c))
    return (c[end] - c[start]) * down[start]


def pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences of as few bytes each as the largest takes."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=np.zeros(1, np.uint64))
    width = max(1, -(-int(steps[1:].max(initial=0)).bit_length() // 8))
    return bytes([width]) + keys[:1].tobytes() + np.ascontiguousarray(steps[1:].view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    width, body = blob[0], np.frombuffer(blob, np.uint8, offset=9).reshape(-1, blob[0])
    steps = np.zeros((len(body) + 1, 8), np.uint8)
    steps[1:, :width], steps[0] = body, np.frombuffer(blob, np.uint8, 8, 1)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of the key space begins in sorted keys, and the end."""
    edges = np.array([-((-i << 64) // n) for i in range(1, n)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)])).astype(np.int64)


SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())])
SENT_DDL, FLAGS_DDL = "bucket int, chunk int, keys binary, extra binary", "chunk int, bucket int, flags binary"


def send(chunk: int, n: int, keys: np.ndarray, extra: np.ndarray | None = None) -> pa.Table:
    """A chunk's rows for the exchange: sorted keys, each with a fixed number of extra bytes."""
    at = buckets(keys, n)
    rows = [(i, chunk, pack(keys[s:e]), b"" if extra is None else extra[s:e].tobytes()) for i, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())) if e > s]
    return pa.table([list(x) for x in zip(*rows)] if rows else [[], [], [], []], schema=SENT)


def exchange(sent: DataFrame, judge: Callable[[np.ndarray, np.ndarray, bytes], np.ndarray]) -> DataFrame:
    """(chunk, bucket, flags): for each blob one byte per key, from judge(keys, chunk of each, extra bytes) over its bucket."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        blobs, chunks = [unpack(x) for x in t["keys"].to_pylist()], t["chunk"].to_numpy()
        counts = np.array([len(x) for x in blobs])
        flags = judge(np.concatenate(blobs), np.repeat(chunks, counts), b"".join(t["extra"].to_pylist())).astype(np.uint8)
        ends = np.cumsum(counts)
        cut = [flags[e - n : e].tobytes() for n, e in zip(counts.tolist(), ends.tolist())]
        return pa.table({"chunk": t["chunk"], "bucket": t["bucket"], "flags": pa.array(cut, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, FLAGS_DDL)


def answered(t: pa.Table) -> np.ndarray:
    """The flags of one chunk, in the order of the keys it sent."""
    return np.frombuffer(b"".join(t.sort_by("bucket")["flags"].to_pylist()), np.uint8)


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive runs of items whose sizes add up to at most ``most``, or one larger item."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)
