"""Removal of passages that repeat across documents, by Rabin-Karp hashes of every token window.

Every run of ``width`` words is hashed. Chunks of documents (ranges of doc_id) send their distinct
window hashes, as arrays of 32 bits each, to buckets of the key space, where Spark counts in how many chunks each occurs. A bucket
holds as many hashes as a chunk at most, so 32 bits tell them apart but for one in a thousand. That only finds
candidates: a window whose hash occurs again gets a 128-bit cryptographic digest of its words, and goes if an earlier chunk
holds its digest, or an earlier document of its own chunk. So a confusion of 64-bit hashes costs time and removes nothing.
The windows that go merge into maximal intervals of words to remove.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import blocks, presplit, workspace

_PIECE = 1 << 20


def window_hashes(words: list[bytes], width: int, known: presplit.Cache) -> np.ndarray:
    """The hash of each run of width words; long documents go in overlapping pieces."""
    n = len(words) - width + 1
    out = []
    for at in range(0, max(0, n), _PIECE):
        part = words[at : at + _PIECE + width - 1]
        c = blocks.prefix(np.fromiter(map(known.__getitem__, part), np.uint64, len(part)))
        start = np.arange(len(part) - width + 1)
        out.append(blocks.mix(blocks.ranges(c, start, start + width)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _windows(t: pa.Table, width: int, bits: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk in order of id; the windows' hashes; the document rank of each; how many each row has."""
    t = t.sort_by([("id", "ascending"), ("text", "ascending")])
    ids = t["id"].to_numpy()
    rank = np.cumsum(np.concatenate(([0], ids[1:] != ids[:-1]))) if len(ids) else ids
    known = presplit.Cache(xxhash.xxh64_intdigest)
    hashes = [window_hashes((x or "").encode("utf-8").split(), width, known) for x in t["text"].to_pylist()]
    counts = np.array([len(h) for h in hashes], np.int64)
    joined = np.concatenate(hashes)
    return t, joined if bits == 64 else joined >> np.uint64(64 - bits) << np.uint64(64 - bits), np.repeat(rank, counts), counts


def _counted(sent: DataFrame) -> DataFrame:
    """(chunk, bucket, flags) for a written table of arrays (bucket, keys): one byte per key, whether it occurs again.

    Arrays are dealt out once, then counted key by key. The first place of an array has its chunk, so both readers of the exchange take
    the same columns of it and share it.
    """

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = left["keys"].combine_chunks()
        size, own = pa.compute.list_value_length(keys).to_numpy(), keys.flatten().to_numpy()
        hit = np.zeros(len(own), np.uint8)
        if right.num_rows:
            shared = np.sort(right["shared"].combine_chunks().flatten().to_numpy())
            hit = (shared[np.minimum(np.searchsorted(shared, own), len(shared) - 1)] == own).astype(np.uint8)
        ends = np.cumsum(size)
        flags = [hit[e - n + 1 : e].tobytes() for n, e in zip(size.tolist(), ends.tolist())]
        return pa.table({"chunk": own[ends - size], "bucket": left["bucket"], "flags": pa.array(flags, pa.binary())})

    dealt = sent.repartition("bucket")
    each = dealt.select(F.col("bucket").alias("of"), F.posexplode_outer("keys").alias("place", "key")).filter("place > 0")
    shared = each.groupBy("of", "key").agg(F.count("*").alias("times")).filter("times > 1").groupBy("of").agg(F.collect_list("key").alias("shared"))
    return dealt.groupBy("bucket").cogroup(shared.groupBy("of")).applyInArrow(mark, blocks.FLAGS_DDL)


def digests(words: list[bytes], starts: list[int], width: int) -> np.ndarray:
    """128 bits of a cryptographic hash of each window of words that begins at one of the starts, as two integers."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first, last = np.concatenate(([0], ends[:-1]))[starts].tolist(), (ends[np.add(starts, width - 1)] - 1).tolist()
    return np.frombuffer(b"".join([hashlib.blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(first, last)]), "<u8").reshape(-1, 2)


def _repeated(keys: np.ndarray, _: np.ndarray, extra: bytes) -> np.ndarray:
    """Whether an earlier chunk has the digest, of which keys are one half; they come in order of their chunks."""
    rest = np.frombuffer(extra, "<u8")
    order = np.lexsort((rest, keys))
    k, r = keys[order], rest[order]
    found = np.zeros(len(keys), bool)
    found[order[1:]] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    return found


def spread(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window that begins at a marked start."""
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(starts)
    edge[at] += 1
    np.subtract.at(edge, at + width, 1)
    return np.cumsum(edge[:n]) > 0


_FOUND = pa.schema([("kind", pa.int32()), ("chunk", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())])
_FOUND_DDL = "kind int, chunk int, bucket int, keys binary, extra binary"
_PLACES, _DIGESTS = 0, 1


def _find(width: int, n: int, bits: int):
    """Of a chunk and the flags of its hashes: the places of its candidates, and their digests for the exchange."""

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        left, hashes, rank, counts = _windows(left, width, bits)
        chunk = left["chunk"][0].as_py()
        own, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        candidate = blocks.answered(right).astype(bool)
        candidate[where[rank > rank[first][where]]] = True
        at = np.flatnonzero(candidate[where])
        if not len(at):
            return pa.table([[] for _ in _FOUND], schema=_FOUND)
        ends = np.cumsum(counts)
        row = np.searchsorted(ends, at, side="right")
        start = at - (ends - counts)[row]
        cuts, texts = np.flatnonzero(np.diff(row, prepend=-1, append=-1)), left["text"]
        found = np.concatenate([digests((texts[int(row[s])].as_py() or "").encode("utf-8").split(), start[s:e].tolist(), width) for s, e in zip(cuts[:-1], cuts[1:])])
        order = np.lexsort((found[:, 1], found[:, 0]))
        new = np.concatenate(([True], (found[order[1:]] != found[order[:-1]]).any(axis=1)))
        of = np.empty(len(at), np.int64)
        of[order] = np.cumsum(new) - 1
        distinct = found[order[new]]
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, of, rank[at])
        code = of << 1 | (rank[at] > least[of])
        new_run = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(start) != 1))))
        runs = np.array([row[new_run], start[new_run], np.diff(np.append(new_run, len(row)))], "<i4")
        places = np.array([len(new_run)], "<i4").tobytes() + runs.tobytes() + code.astype("<i4").tobytes()
        sent = blocks.send(chunk, n, np.ascontiguousarray(distinct[:, 0]), np.ascontiguousarray(distinct[:, 1]))
        none = pa.array([_DIGESTS] * sent.num_rows, pa.int32())
        first_row = pa.table([[_PLACES], [chunk], [-1], [places], [b""]], schema=_FOUND)
        return pa.concat_tables([first_row, pa.table([none, sent["chunk"], sent["bucket"], sent["keys"], sent["extra"]], schema=_FOUND)])

    return find


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 50, target: int = blocks.TARGET, keep: bool = False, bits: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, intervals) for every row; with keep also the kept text.

    Words are runs without the characters 0x20 and 0x09-0x0D. A word goes if a window of ``width``
    words that covers it also starts in a document with a smaller doc_id, as the input stands.
    ``intervals`` are the maximal removed runs [first, end). The kept words are joined by one space. A null text has no words;
    texts shorter than a window stay whole. Rows with equal doc_id are one document to each other and
    don't cut each other; a null doc_id is smaller than all others. An empty table gives no rows; other
    columns are not read. ``bits`` narrows the window hashes, which changes no result.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(doc_id).isNull().alias("no_id"), F.col(text).alias("text"))
    rows, n = blocks.chunked(rows, "id", "text", target)

    def tell(t: pa.Table) -> pa.Table:
        keys = blocks.distinct(_windows(t, width, bits)[1])
        at = blocks.buckets(keys, n)
        full = np.flatnonzero(np.diff(at))
        cut = np.append(at[full], len(keys))
        arrays = pa.ListArray.from_arrays(pa.array(cut + np.arange(len(cut)), pa.int32()), pa.array(np.insert((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), at[full], t["chunk"][0].as_py())))
        return pa.table({"bucket": pa.array(full, pa.int32()), "keys": arrays})

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("id", "ascending"), ("text", "ascending")])
        right = right.sort_by("bucket")
        row, start = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if right.num_rows:  # the places come first
            places = np.frombuffer(right["flags"][0].as_py(), "<i4").astype(np.int64)
            runs, code = places[1 : 1 + 3 * places[0]].reshape(3, -1), places[1 + 3 * places[0] :]
            row = np.repeat(runs[0], runs[2])
            start = np.repeat(runs[1], runs[2]) + np.arange(len(row)) - np.repeat(np.cumsum(runs[2]) - runs[2], runs[2])
            flags = np.frombuffer(b"".join(right["flags"].to_pylist()[1:]), np.uint8)
            goes = (code & 1).astype(bool) | flags[code >> 1].astype(bool)
            row, start = row[goes], start[goes]
        ends = np.searchsorted(row, np.arange(left.num_rows + 1))
        out = {"n_words": [], "n_removed": [], "kept_sha256": [], "intervals": [], "kept": []}
        for i, x in enumerate(left["text"]):
            words, cut = (x.as_py() or "").encode("utf-8").split(), []
            kept = words
            if ends[i] < ends[i + 1]:
                starts = np.zeros(len(words), bool)
                starts[start[ends[i] : ends[i + 1]]] = True
                gone = spread(starts, width, len(words))
                edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                cut = edges.reshape(-1, 2).tolist()
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
            joined = b" ".join(kept)
            for k, v in (("n_words", len(words)), ("n_removed", len(words) - len(kept)), ("kept_sha256", hashlib.sha256(joined).hexdigest()), ("intervals", [{"first": a, "end": b} for a, b in cut]), ("kept", joined.decode("utf-8") if keep else None)):
                out[k].append(v)
        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        ids = pa.array(left["id"].to_numpy(), mask=left["no_id"].to_numpy(zero_copy_only=False))
        types = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "intervals": span, "kept": pa.string()}
        return pa.table({"doc_id": ids} | {k: pa.array(out[k], kind) for k, kind in types.items() if keep or k != "kept"})

    spark = docs.sparkSession
    sent, path = workspace.cut(rows.groupBy("chunk").applyInArrow(tell, "bucket int, keys array<int>"), "keys")
    workspace.release(spark)
    counted, _ = workspace.cut(_counted(sent), "flags")
    workspace.drop(spark, path)
    workspace.release(spark)
    found, _ = workspace.cut(rows.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(_find(width, n, bits), _FOUND_DDL), "candidates")
    workspace.release(spark)
    told = blocks.exchange(found.filter(F.col("kind") == _DIGESTS).drop("kind"), _repeated)
    marks = found.filter(F.col("kind") == _PLACES).select("chunk", "bucket", F.col("keys").alias("flags")).unionByName(told)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, intervals array<struct<first: long, end: long>>" + ", kept string" * keep
    return rows.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(apply, schema)
