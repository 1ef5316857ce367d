"""Near-duplicate documents by the Jaccard similarity of their word shingles: SimHash first, then bands for the pairs that it can't reach.

SimHash goes as in simhash.py, on shingles of this width: fingerprints, ring keys, chain test, Hamming test. Its pairs and rows of
equal fingerprints are verified on the whole sets of shingles. 64 bits at this distance find but a part of the pairs at the threshold
(README), so what is one component by then is passed over in the bands, and bands find the rest.

Candidates of this second step share a band: ``rows`` least values of a text's shingles under seeded hashes. A pair of similarity s shares
one of the ``bands`` with a chance of 1 - (1 - s**rows)**bands, 0.99994 at 0.8 and more above. A candidate pair goes on
if the least values agree in a share that a pair at the threshold falls below with a chance of 10**-9 (six standard
deviations), and is then verified on the whole sets of shingles, so no pair below the threshold links.

All rows of a band are held against its smallest first. What is one component then needs no more pairs. In bands that still
have rows of several components, such rows are compared in blocks of at most ``block`` rows, two blocks at a time: first their
least values, then their _MOST least shingles (all, for most texts). What leaves a task are the few pairs that agree in
both, to be verified like the others. So a very common band takes no list of all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import blocks, simhash, workspace
from tidemark.llm.components import components

#: Shingles of a text that go into a comparison within a band, as 32 bits; more of them would change the last check alone.
_MOST = 2048
#: A-Z to a-z in UTF-8 bytes, everything else as it is.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def all_shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The hashes of all word shingles, repeats included; of a shorter text, the hash of all its words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    joined, width = b" ".join(words), max(1, min(width, len(words)))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1 if words else np.zeros(1, np.int64)
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(ends) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct ones of all_shingles()."""
    return blocks.distinct(all_shingles(text, width, seed))


@lru_cache(maxsize=4)
def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.random.default_rng(11).integers(0, 1 << 64, (2, n), np.uint64)
    return a | np.uint64(1), b


def least_values(own: np.ndarray, bands: int, rows: int) -> np.ndarray:
    a, b = _hashes(bands * rows)
    least = np.full(bands * rows, ~np.uint64(0))
    for at in range(0, len(own), 256):
        np.minimum(least, (own[at : at + 256, None] * a + b).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray, bands: int, rows: int) -> list[int]:
    return [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(bands, rows))]


def least_agreement(n: int, similarity: float) -> int:
    """Of n least values, so many at least agree in a pair of this similarity, but for a chance of about 10**-9."""
    return max(0, math.floor(n * similarity - 6 * math.sqrt(n * similarity * (1 - similarity))))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _signs(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) of rows whose shingles have a Jaccard similarity of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["row"], pa.array([_signed(shingles(t, width)) for t in b["t"].to_pylist()], pa.list_(pa.int64()))], ["row", "s"])
        workspace.give_back()

    ends = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    sets, _ = workspace.cut(texts.join(ends, "row", "left_semi").mapInArrow(run, "row long, s array<long>"), "shingles")
    both = pairs.join(sets.select(F.col("row").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("row").alias("b"), F.col("s").alias("y")), "b")
    n, m, common = F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y"))
    fit = F.when(F.least(n, m) / F.greatest(n, m) >= least, common / (n + m - common) >= least)
    return workspace.cut(both.filter(fit).select("a", "b"), "near")[0]


def _close(pairs: DataFrame, known: DataFrame, agree: int) -> DataFrame:
    """The distinct pairs (a, b) whose sketches agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (_signs(b[c].to_pylist()) for c in "xy")
                yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= agree))

    x, y = (known.select(F.col("row").alias(end), F.col("sketch").alias(name)) for end, name in (("a", "x"), ("b", "y")))
    return workspace.cut(pairs.distinct().join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "pairs")[0]


def bottom(own: np.ndarray) -> np.ndarray:
    return blocks.distinct(own.astype(np.uint32))[:_MOST]


def alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two texts may be similar, by bottom(): exact for texts that fit it, but for 32-bit collisions, else by five standard deviations."""
    union, times = np.unique(np.concatenate((x, y)), return_counts=True)
    if len(x) < _MOST and len(y) < _MOST:
        return np.count_nonzero(times == 2) >= (least - 0.01) * len(union)
    return np.count_nonzero(times[:_MOST] == 2) >= (least - 5 * math.sqrt(least * (1 - least) / _MOST)) * min(_MOST, len(union))


def _meet(named: DataFrame, known: DataFrame, texts: DataFrame, width: int, least: float, agree: int, block: int) -> DataFrame:
    """The pairs (a, b) of different components within a key that may be similar; named has key, row and component ``of``.

    A pair counts in the first band that it shares. Had that band no more than the two of them, it was verified before.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["row"], pa.array([bottom(shingles(t, width)).tobytes() for t in b["t"].to_pylist()], pa.binary())], ["row", "bottom"])

    def compare(g: pa.Table) -> pa.Table:
        signs, row, of, own = _signs(g["sketch"].to_pylist()), g["row"].to_numpy(), g["of"].to_numpy(), g["own"].to_numpy()
        low, one = [np.frombuffer(x, np.uint32) for x in g["bottom"].to_pylist()], g["bi"][0].as_py() == g["bj"][0].as_py()
        keys, here = np.stack(g["keys"].to_numpy()), g["key"][0].as_py()
        out: list[tuple[int, int]] = []
        for i in range(len(row) - 1):
            j = i + 1 + np.flatnonzero((of[i + 1 :] != of[i]) & (one | (own[i + 1 :] != own[i])))
            j = j[(signs[j] == signs[i]).sum(axis=1) >= agree]
            j = j[keys[i][(keys[j] == keys[i]).argmax(axis=1)] == here]  # only in the first band that both share
            out += [(min(row[i], row[k]), max(row[i], row[k])) for k in j.tolist() if alike(low[i], low[k], least)]
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"a": a, "b": b})

    sizes = named.groupBy("key", "of").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("c"), F.count("*").alias("parts")).filter("parts > 1")
    mixed, _ = workspace.cut(named.join(sizes, "key"), "mixed")
    low, _ = workspace.cut(texts.join(mixed.select("row").distinct(), "row", "left_semi").mapInArrow(sketch, "row long, bottom binary"), "bottoms")
    dealt = mixed.withColumn("deals", F.ceil(F.col("c") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("row"), F.col("deals")).cast("int"))
    dealt = dealt.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).select("key", F.least("own", "p").alias("bi"), F.greatest("own", "p").alias("bj"), "own", "row", "of")
    dealt = dealt.join(known.select("row", "sketch", "keys").join(low, "row"), "row")
    return workspace.cut(dealt.groupBy("key", "bi", "bj").applyInArrow(compare, "a long, b long"), "pairs")[0]


def fingerprint_links(known: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The verified pairs (a, b) of rows whose fingerprints are equal or differ in at most two bits; known has row and ``fp``.

    Of equal fingerprints, each row is held against the smallest; of two that differ, the smallest rows against each other.
    """
    classes, _ = workspace.cut(known.groupBy("fp").agg(F.min("row").alias("rep")), "classes")
    equal = known.select("fp", "row").join(classes, "fp").filter("row <> rep").select(F.col("rep").alias("a"), F.col("row").alias("b"))
    pairs = simhash.links(classes).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    met, _ = workspace.cut(equal.unionByName(pairs), "met")
    return _verified(met, texts, width, least)


def near_components(docs: DataFrame, row: str, text: str = "text", width: int = 5, least: float = 0.8, bands: int = 32, rows: int = 6, block: int = 256) -> DataFrame:
    """(node, component) for every row that is linked to another; row is a unique long of each row.

    Null and empty texts have the same one shingle. An empty table gives no rows. The result is written; all other
    tables made on the way are deleted.
    """
    agree = least_agreement(bands * rows, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, values = np.zeros(b.num_rows, np.uint64), []
            for i, t in enumerate(b["t"].to_pylist()):
                own = all_shingles(t, width)
                prints[i] = simhash.of_hashes(own)
                values.append(least_values(blocks.distinct(own), bands, rows))
            keys = pa.array([_signed(band_keys(v, bands, rows)) for v in values], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b["row"], keys, pa.array([(v & np.uint64(255)).astype(np.uint8).tobytes() for v in values], pa.binary()), pa.array(_signed(prints))], ["row", "keys", "sketch", "fp"])
        workspace.give_back()

    workspace.small_batches(docs.sparkSession)
    texts = docs.select(F.col(row).alias("row"), F.col(text).alias("t"))
    with workspace.scratch(docs.sparkSession):
        known, _ = workspace.cut(texts.mapInArrow(run, "row long, keys array<long>, sketch binary, fp long"), "bands")
        by_print = fingerprint_links(known, texts, width, least)
        first = components(by_print, "a", "b")

        keys = known.join(first, F.col("row") == F.col("node"), "left").select(F.explode("keys").alias("key"), "row", F.coalesce("component", "row").alias("of"))
        many = keys.groupBy("key").agg(F.count("*").alias("c"), F.min("row").alias("hub"), F.min_by("of", "row").alias("hub_of")).filter("c > 1")
        shared, _ = workspace.cut(keys.join(many, "key"), "shared")
        stars = _close(shared.filter("of <> hub_of").select(F.col("hub").alias("a"), F.col("row").alias("b")), known, agree)
        links, _ = workspace.cut(by_print.unionByName(_verified(stars, texts, width, least)).distinct(), "links")
        found = components(links, "a", "b")

        named = shared.filter("c > 2").select("key", "row").join(found, F.col("row") == F.col("node"), "left").select("key", "row", F.coalesce("component", "row").alias("of"))
        named, _ = workspace.cut(named, "named")
        rest = _meet(named, known, texts, width, least, agree, block).join(stars, ["a", "b"], "left_anti")
        more = _verified(rest, texts, width, least)
        return workspace.keep(found if more.isEmpty() else components(links.unionByName(more), "a", "b"), "components")
