"""Near-duplicate documents by SimHash, with pigeonring filtering of the candidates.

A 64-bit fingerprint is cut into m parts on a ring. If two fingerprints differ in at most t bits,
some start i exists from which every chain of l parts differs in at most floor(l * t / m) bits
(the strong pigeonring principle). So the first parts of that chain, whose budget is 0, are equal,
and of the parts whose budget is 1 one half is equal: these bits are the join key. Candidates that
share a key then pass the whole chain test before the full Hamming distance is taken.

A key that more than ``dense`` distinct fingerprints share is not paired up. Its members differ only
in the bits outside the key; for t = 2 two of them link exactly if flipping at most one bit of each
meets in one value, so each member names its few flipped values and everything that named the same
value is linked to the smallest. That is linear in the group and finds the same components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import workspace
from tidemark.llm.components import components

BITS = 64
#: A-Z to a-z in UTF-8 bytes, everything else as it is.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _set_bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(set_bits: np.ndarray, n: int) -> int:
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view("<u8")[0])


def of_hashes(h: np.ndarray) -> int:
    """The fingerprint of shingles by their hashes, repeats included: a bit is set if it is in over half of them."""
    return _majority(sum((_set_bits(h[at : at + (1 << 15)]) for at in range(0, len(h), 1 << 15)), np.zeros(BITS, np.int64)), len(h))


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash over all word shingles of a whole text, repeats included; 0 without words.

    bytes.split() cuts at exactly the characters 0x20 and 0x09-0x0D.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends, digest = ends[width - 1 :].tolist(), xxhash.xxh64_intdigest
    set_bits, n = np.zeros(BITS, np.int64), len(starts)
    for at in range(0, n, 1 << 15):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)])], "<u8")
        set_bits += _set_bits(h)
    return _majority(set_bits, n)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id long, fp long): the fingerprint of each row's whole text; null and empty texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, width) for t in b["t"].to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b["i"], pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    workspace.small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, fp long")


def _turned(col: str, by: str) -> str:
    return f"(shiftrightunsigned({col}, {by}) | if({by} = 0, 0L, shiftleft({col}, {BITS} - {by})))"


def budgets(parts: int, distance: int) -> list[int]:
    return [length * distance // parts for length in range(1, parts + 1)]


def _masks(parts: int, distance: int) -> tuple[int, int, int]:
    """Of a turned fingerprint: the bits of budget 0, and two halves of those of budget 1."""
    w, of = BITS // parts, budgets(parts, distance)
    zero, one = sum(b == 0 for b in of), sum(b == 1 for b in of)
    near = one // 2
    bits = lambda lo, hi: ((1 << (hi - lo) * w) - 1) << lo * w
    return bits(0, zero), bits(zero, zero + near), bits(zero + near, zero + one)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def ring_keys(prints: DataFrame, parts: int, distance: int) -> DataFrame:
    """(slot, key, r, rep): for each start of the ring and half of the budget-1 stretch, the key bits; r is the turned fingerprint."""
    w, (zero, *halves) = BITS // parts, _masks(parts, distance)
    slots: list[Column] = []
    for i in range(parts):
        r = F.expr(_turned("fp", str(i * w)))
        for h, half in enumerate(halves):
            slots.append(F.struct(F.lit(2 * i + h).cast("short").alias("slot"), r.bitwiseAND(F.lit(_signed(zero | half))).alias("key"), r.alias("r")))
    return prints.select(F.explode(F.array(*slots)).alias("k"), "rep").select("k.slot", "k.key", "k.r", "rep")


def links(prints: DataFrame, distance: int = 2, parts: int = 8, dense: int = 64) -> DataFrame:
    """(a, b): pairs of ``rep`` whose ``fp`` differ in at most distance bits; of dense keys, enough of them to keep each component.

    prints has one row for each distinct fp with its representative ``rep``.
    """
    if distance != 2:
        raise ValueError("distance must be 2: the exact path for dense keys holds for it alone")
    keys = ring_keys(prints, parts, distance)
    counts = keys.groupBy("slot", "key").agg(F.count("*").alias("c")).filter("c > 1")
    shared, _ = workspace.cut(keys.join(counts, ["slot", "key"]), "ring")
    few, many = shared.filter(F.col("c") <= dense), shared.filter(F.col("c") > dense)

    x = few.select("slot", "key", F.col("r").alias("ra"), F.col("rep").alias("a"))
    y = few.select("slot", "key", F.col("r").alias("rb"), F.col("rep").alias("b"))
    w, chain = BITS // parts, F.col("ra").bitwiseXOR(F.col("rb"))
    near = F.lit(True)
    for length, budget in enumerate(budgets(parts, distance), 1):
        if length == parts or budget > 0:
            near = near & (F.bit_count(chain.bitwiseAND(F.lit(_signed((1 << length * w) - 1)))) <= budget)
    pairs = x.join(y, ["slot", "key"]).filter(F.col("a") < F.col("b")).filter(near).select("a", "b")

    zero, *halves = _masks(parts, distance)
    flips = [F.array(F.col("r"), *(F.col("r").bitwiseXOR(F.lit(_signed(1 << j))) for j in range(BITS) if not (zero | half) >> j & 1)) for half in halves]
    named = many.select("slot", "key", "rep", F.explode(F.when(F.col("slot") % 2 == 0, flips[0]).otherwise(flips[1])).alias("v"))
    least = named.groupBy("slot", "key", "v").agg(F.min("rep").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = named.join(least, ["slot", "key", "v"]).filter("rep <> b").select(F.col("rep").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, distance: int = 2, parts: int = 8, dense: int = 64) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    component_id is the smallest doc_id reachable by links of at most ``distance`` differing bits.
    Null and empty texts have fingerprint 0 and link like any other; a row with a null doc_id joins its
    component but names none (alone, its component_id is null). An empty table gives no rows; other
    columns are not read.
    """
    prints, _ = workspace.cut(fingerprints(docs, doc_id, text, width), "fingerprints")
    classes, _ = workspace.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = components(links(classes.filter("rep is not null"), distance, parts, dense), "a", "b")
    labelled = classes.join(found, classes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(labelled, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
