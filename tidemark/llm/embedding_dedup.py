"""Near-duplicate embeddings: random-hyperplane sign hashing, exact cosines, connected components.

Equal vectors of a label collapse into a class first. Each class gets, in every table, a code from
the signs of its products with random hyperplanes, and a sketch of _SKETCH more signs. The number of hyperplanes of a code follows the
number of classes, so that a bucket stays small, and the number of tables follows from it so that a pair just at the threshold is
missed with a chance of at most ``miss``.

Into the tables go names and sketches, not vectors. In a bucket of at most ``sparse`` classes, pairs whose sketches differ in no more
signs than six standard deviations above what a pair at the threshold differs in are taken; the distinct pairs then fetch their two vectors
for the exact cosine in double precision. Classes of a larger bucket take their vectors along: they are compared in blocks of
``block`` classes, two at a time, so no task holds more than two, and what leaves a task is a count for each class and a spanning forest of
its links, never the pairs. A pair that meets in a larger bucket counts there alone, in the first such table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import workspace
from tidemark.llm.components import components

_KEY = ["label", "dim", "tab", "code", "bi", "bj"]
_SKETCH = 256


def layout(n: int, threshold: float, miss: float = 0.02, per_bucket: int = 8) -> tuple[int, int]:
    """Hyperplanes for each table, and tables."""
    bits = min(30, max(8, math.ceil(math.log2(max(n, 1) / per_bucket + 1))))
    meets = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - meets)))


def planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def codes(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """The code of each vector in each table."""
    signs = vectors @ planes(vectors.shape[1], bits, tables, seed) > 0
    return signs.reshape(len(vectors), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def sketches(vectors: np.ndarray, seed: int) -> np.ndarray:
    """_SKETCH signs of each vector, as 64-bit integers."""
    signs = vectors @ planes(vectors.shape[1], _SKETCH, 1, seed + 1) > 0
    return np.packbits(signs, axis=1, bitorder="little").view("<i8")


def most_apart(threshold: float) -> int:
    """Signs in which the sketches of a pair at the threshold differ at most, but for a chance of about 10**-9."""
    p = math.acos(threshold) / math.pi
    return math.ceil(_SKETCH * p + 6 * math.sqrt(_SKETCH * p * (1 - p)))


def forest(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the smallest row it reaches."""
    label = np.arange(len(near))
    while True:
        least = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1))
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def _compare(g: pd.DataFrame, threshold: float) -> pd.DataFrame | None:
    """Of one bucket, or two blocks of one: each linked class with the size it links to and a class it reaches."""
    key = g.iloc[0]
    v = np.stack(g["v"].to_numpy()).astype(np.float64)
    v = v / np.sqrt((v * v).sum(axis=1))[:, None]
    code, size, rep = np.stack(g["codes"].to_numpy()), g["size"].to_numpy(), g["rep"].to_numpy()
    near = v @ v.T >= threshold
    np.fill_diagonal(near, False)
    if key["bi"] != key["bj"]:
        other = g["own"].to_numpy() != key["bi"]
        near &= other[:, None] != other[None, :]
    x, y = np.nonzero(near)
    if not len(x):
        return None
    before = ((code[x, : key["tab"]] == code[y, : key["tab"]]) & (code[x, : key["tab"]] >= 0)).any(axis=1)
    near[x[before], y[before]] = False
    hit = near.any(axis=1)
    if not hit.any():
        return None
    return pd.DataFrame({"rep": rep[hit], "more": (near @ size)[hit], "to": rep[forest(near)[hit]]})


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.93, miss: float = 0.02, block: int = 512, sparse: int = 32, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors are compared when their labels are equal and not null and they have the same length.
    Null, empty and zero vectors, and those with null or non-finite components, link with nothing: n_links 0,
    component_id their own vec_id. Every link found has cosine >= threshold; a pair at the threshold is missed
    with a chance of at most ``miss``, nearer ones with less. Repeated rows are equal vectors and link. A row with a null
    vec_id links with nothing, so its component_id is null. An empty table gives no rows; other columns are not read.
    """
    e = F.col("v")
    kind = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast(kind).alias("v"))
    fine = e.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.exists(e, lambda c: c != 0) & F.forall(e, lambda c: c.isNotNull() & (F.abs(c) < float("inf"))), F.lit(False))
    rows = rows.withColumn("fine", fine)
    classes = rows.filter("fine").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    classes, _ = workspace.cut(classes.withColumn("dim", F.size("v")), "classes")
    n = classes.count()
    bits, tables = layout(n, threshold, miss)

    words = _SKETCH // 64

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim = b["dim"].to_numpy()
            for d in np.unique(dim).tolist():
                own = b.filter(pa.array(dim == d))
                v = own["v"].flatten().to_numpy().astype(np.float64).reshape(-1, d)
                c, s = codes(v, bits, tables, seed).astype(np.int32), sketches(v, seed)
                yield pa.RecordBatch.from_arrays([own["rep"], pa.array(list(c), pa.list_(pa.int32())), pa.array(list(s), pa.list_(pa.int64()))], ["rep", "codes", "sketch"])

    coded, _ = workspace.cut(classes.select("rep", "dim", "v").mapInArrow(code, "rep long, codes array<int>, sketch array<long>"), "codes")
    coded = coded.join(classes.select("rep", "label", "dim"), "rep")
    each = coded.select("label", "dim", "rep", F.posexplode("codes").alias("tab", "code"), "sketch")
    bucket = ["label", "dim", "tab", "code"]
    crowded = each.groupBy(*bucket).agg(F.count("*").alias("c")).filter("c > 1")
    met, _ = workspace.cut(each.join(crowded, bucket), "buckets")

    full = met.filter(F.col("c") > sparse)
    places, _ = workspace.cut(full.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("tab", "code"))).alias("m")).select("rep", F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.coalesce(F.col("m")[t], F.lit(-1))).alias("codes")), "places")
    vectors_, _ = workspace.cut(classes.select("rep", "size", "v").join(places, "rep", "left"), "vectors")
    parts = F.ceil(F.col("c") / block).cast("int")
    dense = full.select(*bucket, "rep", "c").withColumn("own", F.pmod(F.xxhash64("rep"), parts).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), parts - 1)))
    dense = dense.withColumn("bi", F.least("own", "p")).withColumn("bj", F.greatest("own", "p")).join(vectors_, "rep")
    dealt = dense.select(*_KEY, "own", "rep", "size", "v", "codes").repartition(*_KEY).sortWithinPartitions(*_KEY)

    few = met.filter(F.col("c") <= sparse)
    signs = lambda name: [F.col("sketch")[k].alias(f"{name}{k}") for k in range(words)]
    apart = sum((F.bit_count(F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}"))) for k in range(words)), F.lit(0))
    near = few.select(*bucket, F.col("rep").alias("a"), *signs("x")).join(few.select(*bucket, F.col("rep").alias("b"), *signs("y")), bucket)
    near, _ = workspace.cut(near.filter((F.col("a") < F.col("b")) & (apart <= most_apart(threshold))).select("a", "b").distinct(), "pairs")
    of = lambda end, v, c, n: vectors_.select(F.col("rep").alias(end), F.col("v").alias(v), F.col("codes").alias(c), F.col("size").alias(n))
    pairs = near.join(of("a", "x", "cx", "na"), "a").join(of("b", "y", "cy", "nb"), "b")
    pairs = pairs.filter(~F.coalesce(F.exists(F.arrays_zip("cx", "cy"), lambda z: (z["cx"] >= 0) & (z["cx"] == z["cy"])), F.lit(False)))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pa.compute.list_value_length(b["x"]).to_numpy()
            for d in np.unique(size).tolist():
                own = b.filter(pa.array(size == d))
                x, y = (own[c].flatten().to_numpy().astype(np.float64).reshape(-1, d) for c in "xy")
                x, y = (m / np.sqrt((m * m).sum(axis=1))[:, None] for m in (x, y))
                yield own.select(["a", "b", "na", "nb"]).filter(pa.array((x * y).sum(axis=1) >= threshold))

    links, _ = workspace.cut(pairs.select("a", "b", "na", "nb", "x", "y").mapInArrow(verify, "a long, b long, na long, nb long"), "links")
    single = links.select(F.col("a").alias("rep"), F.col("nb").alias("more"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("rep"), F.col("na").alias("more"), F.col("a").alias("to")))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            new = (b[_KEY] != b[_KEY].shift()).any(axis=1).to_numpy()
            at = np.flatnonzero(new).tolist()
            out = [_compare(b.iloc[s:t], threshold) for s, t in zip(at, at[1:]) if t - s > 1]
            rest = b.iloc[at[-1] :]
            out = [x for x in out if x is not None]
            if out:
                yield pd.concat(out)
        if rest is not None and len(rest) > 1 and (last := _compare(rest, threshold)) is not None:
            yield last

    linked, _ = workspace.cut(dealt.mapInPandas(compare, "rep long, more long, to long").unionByName(single), "linked")
    counts = linked.groupBy("rep").agg(F.sum("more").alias("more"))
    found = components(linked.select("rep", "to"), "rep", "to")
    named = classes.join(found, classes["rep"] == found["node"], "left").join(counts, "rep", "left")
    named = named.select("label", "v", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linkable = rows.filter("fine").join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("fine")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linkable.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
