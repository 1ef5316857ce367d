"""Best-fit packing of documents into training sequences of several permitted lengths.

Only the number of pieces of each length decides a packing, and there are at most as many lengths as the largest
sequence has tokens, so the plan is made on the driver from that histogram, of bounded size whatever the corpus.
A sequence costs its length, times a term for attention that grows with it, and a constant. Lengths are taken in
descending order. A piece goes into the open bin that it fills best; if it fits none, bins open of the size that costs
least for each token that all remaining pieces can put into so many of them. At the end each bin shrinks to the
smallest permitted size that holds its contents. Which of the permitted sizes may open is decided by the cost of
the whole plan: sizes are left out one after the other as long as that makes it cheaper. Equal bins are kept as ranges, never one by one.

Pieces of a length are numbered in parallel (per salt, then offset), and number and length give
the bin.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import workspace


@dataclass
class Plan:
    """placed: (length, first number, pieces, first bin, offset in the bin); bins: (first bin, bins, tokens, size)."""

    placed: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    bins: list[tuple[int, int, int, int]] = field(default_factory=list)
    cost: float = 0.0


def prices(permitted: list[int], bin_cost: float = 16.0, model_width: int = 4096) -> dict[int, float]:
    """What a sequence of each size costs, in tokens of linear work: attention adds size / (6 model widths) for each token."""
    return {c: c * (1 + c / (6 * model_width)) + bin_cost for c in permitted}


def least_cost(histogram: dict[int, int], price: dict[int, float]) -> float:
    """What no packing can go below: each token at the lowest rate of the sizes that hold its piece."""
    return sum(n * x * min(p / c for c, p in price.items() if c >= x) for x, n in histogram.items() if n)


def _plan(histogram: dict[int, int], sizes: list[int], price: dict[int, float]) -> Plan:
    plan, rooms, opened, permitted = Plan(), [], 0, sorted(price)
    rest = sorted(x for x, n in histogram.items() if n)  # lengths not yet begun
    open_bins: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # room -> (first bin, bins, tokens)
    closed: list[tuple[int, int, int]] = []

    def put_back(room: int, first: int, count: int, used: int) -> None:
        if room <= 0:
            closed.append((first, count, used))
            return
        if not open_bins[room]:
            insort(rooms, room)
        open_bins[room].append((first, count, used))

    def rate(size: int) -> float:
        """The cost of a token in as many bins of a size as the rest of this length takes, filled up with shorter pieces."""
        each = min(left, size // length)
        bins, room = left // each, size - each * length
        k = len(rest)
        while room and (k := bisect_right(rest, room, 0, k)):
            k -= 1
            room -= min(room // rest[k], histogram[rest[k]] // bins) * rest[k]
        return price[size] / (size - room)

    while rest:
        length = rest.pop()
        number, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count, used = open_bins[room].pop()
                if not open_bins[room]:
                    rooms.pop(at)
                take = min(left, count)
                plan.placed.append((length, number, take, first, used))
                if take < count:
                    put_back(room, first + take, count - take, used)
                put_back(room - length, first, take, used + length)
            else:
                size = min((c for c in sizes if c >= length), key=lambda c: (rate(c), -c))
                each = min(left, size // length)
                count = left // each
                take = count * each
                for k in range(each):
                    plan.placed.append((length, number + k * count, count, opened, k * length))
                put_back(size - each * length, opened, count, each * length)
                opened += count
            number, left = number + take, left - take
    for room, held in open_bins.items():
        closed += held
    for first, count, used in sorted(closed):
        size = next(c for c in permitted if c >= used)
        plan.bins.append((first, count, used, size))
        plan.cost += count * price[size]
    plan.placed.sort()
    return plan


def best_plan(histogram: dict[int, int], permitted: list[int], bin_cost: float = 16.0, model_width: int = 4096) -> Plan:
    """The cheapest plan found by leaving out permitted sizes, one after the other, while the whole plan gets cheaper."""
    sizes, longest = sorted(set(permitted)), max((x for x, n in histogram.items() if n), default=0)
    if not sizes or sizes[0] < 1 or longest > sizes[-1]:
        raise ValueError("the permitted sizes must be positive and hold the longest piece")
    price = prices(sizes, bin_cost, model_width)
    best = _plan(histogram, sizes, price)
    while True:
        fewer = [x for x in ([c for c in sizes if c != gone] for gone in sizes) if x and x[-1] >= longest]
        found = min(((_plan(histogram, x, price), x) for x in fewer), key=lambda p: p[0].cost, default=None)
        if found is None or found[0].cost >= best.cost:
            return best
        best, sizes = found


def pieces(lengths: DataFrame, doc_id: str, n_tokens: str, longest: int) -> DataFrame:
    """(doc_id, piece, first, n): documents cut into pieces of at most ``longest`` tokens; rows without tokens have none."""
    n = F.col(n_tokens).cast("long")
    last = F.floor((n - 1) / F.lit(longest)).cast("long")
    cut = lengths.filter(n > 0).select(F.col(doc_id).alias("doc_id"), n.alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    first = F.col("piece") * longest
    return cut.select("doc_id", "piece", first.alias("first"), F.least(F.col("total") - first, F.lit(longest)).cast("int").alias("n"))


def numbered(rows: DataFrame, per_salt: int | None = None) -> tuple[DataFrame, dict[int, int]]:
    """rows with ``number``, 0 and up within each n by (salt, doc_id, piece); and the histogram of n.

    A length that many pieces share is spread over salts by a hash of the document, about per_salt to each, so no
    task orders all of it. By default that is one in 2,048 of all pieces, but 200 at least and 200,000 at most. So the offsets are
    at most one for each n and each per_salt rows: a few thousand up to 400 million pieces, then one in 200,000 pieces.
    """
    histogram = {r["n"]: r["c"] for r in rows.groupBy("n").agg(F.count("*").alias("c")).collect()}
    per_salt = per_salt or max(200, min(200_000, sum(histogram.values()) // 2048))
    spread = rows.sparkSession.createDataFrame([(n, -(-c // per_salt)) for n, c in sorted(histogram.items())], "n int, salts long")
    salted = rows.join(F.broadcast(spread), "n").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts"))).drop("salts")
    before = Window.partitionBy("n").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("n", "salt").agg(F.count("*").alias("c"))
    offsets, _ = workspace.cut(counts.select("n", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset")), "offsets")
    within = F.row_number().over(Window.partitionBy("n", "salt").orderBy("doc_id", "piece"))
    out = salted.withColumn("within", within).join(offsets, ["n", "salt"])
    return out.withColumn("number", F.col("offset") + F.col("within") - 1).drop("salt", "within", "offset"), histogram


def pack(lengths: DataFrame, permitted: tuple[int, ...] = (512, 1024, 2048, 4096), doc_id: str = "doc_id", n_tokens: str = "n_tokens", bin_cost: float = 16.0, model_width: int = 4096) -> DataFrame:
    """(doc_id, piece, first, n, bin_id, offset, bin_tokens, bin_size) for every piece of every row with tokens.

    Piece number ``piece`` of a document is its tokens from ``first``, ``n`` of them; it lies at ``offset`` of bin
    ``bin_id``, which holds bin_tokens tokens and has the permitted length bin_size. Rows whose n_tokens is
    null or not positive have no piece. Longer documents than the largest length are cut into full pieces
    and a rest. Repeated rows and null doc_ids are packed like any other. An empty table gives no rows; other columns are not read.
    """
    rows, _ = workspace.cut(pieces(lengths, doc_id, n_tokens, max(permitted)), "pieces")
    given, histogram = numbered(rows)
    plan = best_plan(histogram, list(permitted), bin_cost, model_width)
    placed, bins = np.array(plan.placed, np.int64).reshape(-1, 5), np.array(plan.bins, np.int64).reshape(-1, 4)
    shared = rows.sparkSession.sparkContext.broadcast((placed, placed[:, 0] << 44 | placed[:, 1], bins))

    @F.pandas_udf("bin_id long, offset int, bin_tokens int, bin_size int")
    def place(n: pd.Series, number: pd.Series) -> pd.DataFrame:
        at, key, of = shared.value
        i = np.searchsorted(key, n.to_numpy().astype(np.int64) << 44 | number.to_numpy(), side="right") - 1
        bin_id = at[i, 3] + number.to_numpy() - at[i, 1]
        j = np.searchsorted(of[:, 0], bin_id, side="right") - 1
        return pd.DataFrame({"bin_id": bin_id, "offset": at[i, 4], "bin_tokens": of[j, 2], "bin_size": of[j, 3]})

    return given.withColumn("at", place("n", "number")).select("doc_id", "piece", "first", "n", "at.bin_id", "at.offset", "at.bin_tokens", "at.bin_size")
