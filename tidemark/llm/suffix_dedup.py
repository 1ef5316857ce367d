"""Removal of byte strings that repeat anywhere in a corpus, by suffix sorting.

Sorting all suffixes of a corpus at once doesn't split into bounded tasks, so equal strings first
meet by content. The hashes of the half-width strings inside a window have a least one, the window's anchor; equal windows
have equal anchors at equal places. The neighbouring windows of one anchor make up a fragment, so a
repeated window lies in two fragments with the same anchor hash.

Hashes of 64 bits only bring together what may be equal. Whether fragments or windows are equal is decided by 128-bit cryptographic
digests of their bytes, or by the sort, which compares the bytes; nothing goes because 64-bit hashes agree.

1. Chunks of documents (by a hash of id and text) exchange the distinct (anchor, fragment digest) pairs that they hold.
2. A fragment that occurs twice as a whole needs no sorting: its suffixes and those of its copy are pairs of neighbours
   anyway, so all its windows repeat. One whose anchor occurs nowhere else has none. All others, with the
   fragments that share their anchor (one copy of each), go to the sort. A window reaches so far to the left of its anchor
   and so far to the right; of each fragment only the stretch is kept where another one agrees with it nearly that far. These
   stretches are sorted by linear grouping (suffix_sort), and their repeated windows are read off neighbouring suffixes.
3. The spans of each chunk come back to its documents and are cut out.

An anchor with more than ``dense`` distinct fragments (the ends of a very common passage) would be one long
sort. The digests of its fragments' windows are exchanged instead, once from each chunk.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import blocks, workspace
from tidemark.llm.suffix_sort import repeated_windows

_SLICE, _PIECE, _PLACE = 1 << 17, 1 << 23, np.uint64((1 << 24) - 1)
_SYMBOL = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_ENTRY = np.dtype([("frag", "<u8"), ("rest", "<u8"), ("n", "u1")])
_WINDOW = np.dtype([("rest", "<u8"), ("n", "u1")])
WHOLE, SORT, DENSE = 1, 2, 4
_SPANS, _SORTED, _WINDOWS, _FLAGS = 0, 1, 2, 3


@dataclass
class Fragments:
    """Of each fragment: its row, the first and last start of its windows, anchor hash, where the anchor begins in it, and the two halves of its digest."""

    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    key: np.ndarray
    anchor: np.ndarray
    frag: np.ndarray
    rest: np.ndarray

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct (key, digest) in order, how often each occurs (2 for more), which each fragment is, and one fragment of each."""
        order = grouped(self.key, self.frag, self.rest)
        k, f, r = self.key[order], self.frag[order], self.rest[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (f[1:] != f[:-1]) | (r[1:] != r[:-1])))[: len(k)]
        at = np.flatnonzero(new)
        of = np.empty(len(k), np.int64)
        of[order] = np.cumsum(new) - 1
        extra = np.empty(len(at), _ENTRY)
        extra["frag"], extra["rest"], extra["n"] = f[at], r[at], np.minimum(np.diff(np.append(at, len(k))), 2)
        return k[at], extra, of, order[at]


def grouped(key: np.ndarray, frag: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """An order by key in which equal triples are neighbours."""
    order = np.lexsort((frag, key))
    k, f, r = key[order], frag[order], rest[order]
    same = (k[1:] == k[:-1]) & (f[1:] == f[:-1])
    return np.lexsort((rest, frag, key)) if (same & (r[1:] != r[:-1])).any() else order


def digests(pieces: Iterable[bytes]) -> np.ndarray:
    """The two halves of the 128-bit digest of each piece."""
    return np.frombuffer(b"".join([hashlib.blake2b(p, digest_size=16).digest() for p in pieces]), "<u8").reshape(-1, 2)


def narrow(x: np.ndarray, bits: int) -> np.ndarray:
    return x if bits == 64 else x >> np.uint64(64 - bits) << np.uint64(64 - bits)


def _pieces(texts: list[bytes], width: int) -> Iterator[tuple[int, int, bytes]]:
    for row, t in enumerate(texts):
        for at in range(0, max(1, len(t) - width + 1) if len(t) >= width else 0, _PIECE):
            yield row, at, t[at : at + _PIECE + width - 1]


def fragments(texts: list[bytes], width: int, bits: int = 64) -> Fragments:
    half = width // 2
    span = width - half + 1
    pieces, out = list(_pieces(texts, width)), [[np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64), np.zeros(0, np.int64)] + [np.zeros(0, np.uint64)] * 2]
    for s, e in blocks.slices([len(p) for _, _, p in pieces], _SLICE):
        part = pieces[s:e]
        size = np.array([len(p) for _, _, p in part])
        stop, owner = np.cumsum(size), np.repeat(np.arange(e - s), size)
        data = b"".join(p for _, _, p in part)
        c = blocks.prefix(_SYMBOL[np.frombuffer(data, np.uint8)])
        n = len(c) - 1
        at = np.arange(n - half + 1)
        hashes = blocks.mix(blocks.ranges(c, at, at + half))
        least, done = (hashes & ~_PLACE) | at.astype(np.uint64), 1
        while done < span:
            step = min(done, span - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        start = np.flatnonzero(stop[owner[: n - width + 1]] >= np.arange(n - width + 1) + width)
        anchor = (least[start] & _PLACE).astype(np.int64)
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)))
        begin = np.flatnonzero(new)
        first, last, anchor = start[begin], start[np.append(begin[1:], len(start)) - 1], anchor[begin]
        digest = digests(data[x:y] for x, y in zip(first.tolist(), (last + width).tolist()))
        row = np.array([r for r, _, _ in part])[owner[first]]
        shift = np.array([o for _, o, _ in part])[owner[first]] - (stop - size)[owner[first]]
        key = blocks.mix(hashes[anchor] + np.uint64(1))  # anchors have small hashes; spread them over all buckets
        out.append([row, first + shift, last + shift, narrow(key, bits), anchor - first, narrow(digest[:, 0], bits), digest[:, 1]])
    return Fragments(*(np.concatenate(x) for x in zip(*out)))


def _ordered(t: pa.Table) -> tuple[pa.Table, list[bytes]]:
    """A chunk's rows in an order that only their ids and texts decide."""
    t = t.sort_by([("row_id", "ascending"), ("row_text", "ascending")])
    return t, [x or b"" for x in t["row_text"].to_pylist()]


def _judge(dense: int):
    def judge(keys: np.ndarray, _: np.ndarray, extra: bytes) -> np.ndarray:
        e = np.frombuffer(extra, _ENTRY)
        order = grouped(keys, e["frag"], e["rest"])
        k, f, r, n = keys[order], e["frag"][order], e["rest"][order], e["n"][order].astype(np.int64)
        new_key = np.concatenate(([True], k[1:] != k[:-1]))
        new = new_key | np.concatenate(([True], (f[1:] != f[:-1]) | (r[1:] != r[:-1])))
        of, of_key = np.cumsum(new) - 1, np.cumsum(new_key) - 1
        times = np.bincount(of, n)
        kinds, single = np.bincount(of_key, new), np.bincount(of_key, new & (times[of] == 1))
        sort = (kinds > 1) & (single > 0)
        flags = np.empty(len(keys), np.uint8)
        flags[order] = (times[of] > 1) * WHOLE + sort[of_key] * np.where(kinds > dense, DENSE, SORT)[of_key]
        return flags

    return judge


def _repeats(keys: np.ndarray, _: np.ndarray, extra: bytes) -> np.ndarray:
    """Whether a digest, of which keys are one half, occurs twice over all chunks, or was sent as occurring twice."""
    e = np.frombuffer(extra, _WINDOW)
    order = np.lexsort((e["rest"], keys))
    k, r = keys[order], e["rest"][order]
    of = np.empty(len(keys), np.int64)
    of[order] = np.cumsum(np.concatenate(([True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])))[: len(k)]) - 1
    return np.bincount(of, e["n"].astype(np.int64))[of] > 1


def _blob(*columns: np.ndarray) -> bytes:
    return np.array(columns, "<i8").tobytes()


def _columns(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<i8").reshape(n, -1)


_FOUND = pa.schema([("kind", pa.int32()), ("chunk", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary()), ("key", pa.int64()), ("frag", pa.binary()), ("row", pa.int64()), ("first", pa.int64()), ("anchor", pa.int32())])
_FOUND_DDL = "kind int, chunk int, bucket int, keys binary, extra binary, key long, frag binary, row long, first long, anchor int"


def _find(width: int, n: int, bits: int):
    """Of a chunk and the flags of its entries: spans known to repeat, fragments to sort, windows of dense anchors."""

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        left, texts = _ordered(left)
        chunk, f = left["chunk"][0].as_py(), fragments(texts, width, bits)
        keys, extra, of, one = f.entries()
        told = blocks.answered(right)
        mine = told[of]
        rows: list[tuple] = []
        whole = np.flatnonzero(mine & WHOLE)
        if len(whole):
            row, a, b = f.row[whole], f.first[whole], f.last[whole]
            new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (a[1:] != b[:-1] + 1))))
            rows.append((_SPANS, chunk, 0, _blob(row[new], a[new], b[np.append(new[1:], len(row)) - 1] + width), None, 0, b"", 0, 0, 0))
        for x in np.flatnonzero(told & SORT).tolist():
            i = one[x]
            at = int(f.first[i])
            data = texts[f.row[i]][at : int(f.last[i]) + width]
            rows.append((_SORTED, -1 if told[x] & WHOLE else chunk, int(keys[x] % np.uint64(8 * n)), data, None, int(keys[x].astype(np.int64)), extra[x].tobytes()[:16], int(f.row[i]), at, int(f.anchor[i])))
        dense = np.flatnonzero(mine & DENSE)
        if len(dense):
            size = (f.last - f.first + 1)[dense]
            row, start = np.repeat(f.row[dense], size), np.concatenate([np.arange(a, a + m) for a, m in zip(f.first[dense], size)])
            found = digests(texts[r][s : s + width] for r, s in zip(row.tolist(), start.tolist()))
            order = np.lexsort((found[:, 1], found[:, 0]))
            at = np.flatnonzero(np.concatenate(([True], (found[order[1:]] != found[order[:-1]]).any(axis=1))))
            where = np.empty(len(order), np.int64)
            where[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
            own, more = found[order[at]], np.empty(len(at), _WINDOW)
            more["rest"], more["n"] = own[:, 1], np.minimum(np.diff(np.append(at, len(order))), 2)
            rows.append((_WINDOWS, chunk, -1, _blob(where, row, start), None, 0, b"", 0, 0, 0))
            sent = blocks.send(chunk, n, np.ascontiguousarray(own[:, 0]), more)
            rows += [(_FLAGS, chunk, r["bucket"], r["keys"], r["extra"], 0, b"", 0, 0, 0) for r in sent.to_pylist()]
        return pa.table([list(x) for x in zip(*rows)] if rows else [[] for _ in _FOUND], schema=_FOUND)

    return find


def stretches(data: list[bytes], anchors: list[int], width: int, classes: int = 10) -> list[tuple[int, int]]:
    """Of each fragment of one anchor the first and last start of windows that may occur in another of them; (0, -1) if none.

    Windows are put in classes by how far they reach to the left of the anchor. All of a class hold the same bytes but for a few at
    the ends, so a window can only occur again where these bytes do.
    """
    span = width - width // 2
    step = max(1, span // classes)
    held, times = [], Counter()
    for d, a in zip(data, anchors):
        last = len(d) - width
        own = []
        for left in range(max(0, (a - last) // step * step), min(span, a) + 1, step):
            lo, hi = max(0, a - left - step + 1), min(last, a - left)
            if lo <= hi:
                own.append((left, d[a - left : a + width - left - step + 1], lo, hi))
        times.update((left, x) for left, x, _, _ in own)
        held.append(own)
    out = []
    for own in held:
        hit = [(lo, hi) for left, x, lo, hi in own if times[left, x] > 1]
        out.append((min(lo for lo, _ in hit), max(hi for _, hi in hit)) if hit else (0, -1))
    return out


def _sorter(width: int, most: int):
    """Of the fragments of a bucket of anchors: the spans of their repeated windows, by chunk."""

    def solve(t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("frag", "ascending"), ("chunk", "descending")])
        chunk, row, first, anchor = (t[c].to_numpy() for c in ("chunk", "row", "first", "anchor"))
        key, frag, data = t["key"].to_numpy(), t["frag"].to_pylist(), t["keys"].to_pylist()
        keep = np.concatenate(([True], (key[1:] != key[:-1]) | np.array([x != y for x, y in zip(frag[1:], frag)], bool)))
        at = np.flatnonzero(keep)
        groups = np.append(np.flatnonzero(np.concatenate(([True], key[at][1:] != key[at][:-1]))), len(at))
        cut: list[list[tuple[int, int, bytes]]] = []
        for s, e in zip(groups[:-1], groups[1:]):
            own = at[s:e].tolist()
            parts = stretches([data[i] for i in own], anchor[own].tolist(), width)
            cut.append([(i, lo, data[i][lo : hi + width]) for i, (lo, hi) in zip(own, parts) if lo <= hi])
        out: list[tuple[int, int, int, int]] = []
        for s, e in blocks.slices([sum(len(d) for _, _, d in x) for x in cut], most):
            own = [x for part in cut[s:e] for x in part]
            for (i, lo, _), starts in zip(own, repeated_windows([d for _, _, d in own], width)):
                if chunk[i] >= 0:
                    begin = int(first[i]) + lo
                    out += [(int(chunk[i]), int(row[i]), begin + x, begin + x + width) for x in starts]
        found = np.array(out, np.int64).reshape(-1, 4)
        rows = [(c, _blob(*found[found[:, 0] == c].T[1:])) for c in np.unique(found[:, 0]).tolist()]
        return pa.table({"chunk": pa.array([c for c, _ in rows], pa.int32()), "blob": pa.array([b for _, b in rows], pa.binary())})

    return solve


def _spans(marks: pa.Table) -> np.ndarray:
    """(row, first, end) of a chunk, maximal and in order."""
    marks = marks.sort_by([("kind", "ascending"), ("bucket", "ascending")])
    kinds, blobs = marks["kind"].to_pylist(), marks["blob"].to_pylist()
    found = [_columns(b, 3).T for k, b in zip(kinds, blobs) if k in (_SPANS, _SORTED)]
    windows = [_columns(b, 3) for k, b in zip(kinds, blobs) if k == _WINDOWS]
    if windows:
        where, row, start = windows[0]
        hit = np.frombuffer(b"".join(b for k, b in zip(kinds, blobs) if k == _FLAGS), np.uint8).astype(bool)[where]
        width = int(marks["width"][0].as_py())
        found.append(np.stack([row[hit], start[hit], start[hit] + width], axis=1))
    if not found:
        return np.zeros((0, 3), np.int64)
    x = np.concatenate(found)
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    base = x[:, 0] * (1 << 40)
    reach = np.maximum.accumulate(base + x[:, 2]) if len(x) else base
    new = np.flatnonzero(np.concatenate(([True], (base + x[:, 1])[1:] > reach[:-1]))[: len(x)])
    return np.stack([x[new, 0], x[new, 1], reach[np.append(new[1:], len(x)) - 1] - base[new]], axis=1)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 200, target: int = blocks.TARGET, dense: int = 512, sort_bytes: int = 1 << 16, texts: bool = False, bits: int = 64) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row; or, with texts, docs itself with each text cut.

    A byte goes if a string of ``width`` bytes that covers it also starts anywhere else, in this document or
    another, as the input stands; strings never cross documents. Null counts as empty; texts shorter than width stay whole.
    Repeated rows are copies of each other, so all their bytes go if they are long enough. With ``texts`` a
    character that lost any of its bytes goes as a whole, null stays null, and all other columns are
    passed on as they are, whatever their names. An empty table gives no rows. ``bits`` narrows the hashes, which changes no result.
    """
    spark = docs.sparkSession
    if texts:
        base = docs.select(F.struct("*").alias("whole"), F.col(doc_id).alias("row_id0"), F.col(text).alias("t0"))
        rows = base.select("whole", F.coalesce(F.col("row_id0").cast("long"), F.lit(-(1 << 63))).alias("row_id"), F.lit(True).alias("has_id"), F.encode(F.col("t0"), "UTF-8").alias("row_text"))
    else:
        rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("row_id"), F.col(doc_id).isNotNull().alias("has_id"), F.encode(F.col(text), "UTF-8").alias("row_text"))
    rows, n = blocks.scattered(rows, ["row_id", "row_text"], "row_text", target)
    bare = rows.select("row_id", "row_text", "chunk")

    def tell(t: pa.Table) -> pa.Table:
        keys, extra, _, _ = fragments([x or b"" for x in t["row_text"].to_pylist()], width, bits).entries()
        return blocks.send(t["chunk"][0].as_py(), n, keys, extra)

    told = blocks.exchange(bare.groupBy("chunk").applyInArrow(tell, blocks.SENT_DDL), _judge(dense))
    found, _ = workspace.cut(bare.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_find(width, n, bits), _FOUND_DDL), "fragments")
    direct = found.filter(F.col("kind").isin(_SPANS, _WINDOWS)).select("chunk", "kind", "bucket", F.col("keys").alias("blob"))
    by_sort = found.filter(F.col("kind") == _SORTED).select("bucket", "chunk", "key", "frag", "row", "first", "anchor", "keys").groupBy("bucket").applyInArrow(_sorter(width, sort_bytes), "chunk int, blob binary")
    by_sort = by_sort.select("chunk", F.lit(_SORTED).alias("kind"), F.lit(0).alias("bucket"), "blob")
    flags = blocks.exchange(found.filter(F.col("kind") == _FLAGS).select("bucket", "chunk", "keys", "extra"), _repeats)
    flags = flags.select("chunk", F.lit(_FLAGS).alias("kind"), "bucket", F.col("flags").alias("blob"))
    marks = direct.unionByName(by_sort).unionByName(flags).withColumn("width", F.lit(width))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        left, data = _ordered(left)
        spans = _spans(right)
        at = np.searchsorted(spans[:, 0], np.arange(len(data) + 1))
        kept = []
        for i, t in enumerate(data):
            if at[i] < at[i + 1]:
                own = spans[at[i] : at[i + 1]]
                edges = [0, *own[:, 1:].ravel().tolist(), len(t)]
                t = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2]))
            kept.append(t)
        if texts:
            new = pa.array([None if v is None else k.decode("utf-8", "ignore") for v, k in zip(left["row_text"].to_pylist(), kept)], pa.string())
            return pa.table({"whole": left["whole"].combine_chunks(), "kept": new})
        size = np.array([len(t) for t in data], np.int64)
        ids = pa.array(left["row_id"].to_numpy(), mask=~left["has_id"].to_numpy(zero_copy_only=False))
        return pa.table({"doc_id": ids, "n_bytes": size, "n_removed": size - np.array([len(k) for k in kept], np.int64), "n_spans": np.diff(at), "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]})

    joined = rows.groupBy("chunk").cogroup(marks.groupBy("chunk"))
    if not texts:
        return joined.applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    whole = docs.schema
    done = joined.applyInArrow(cut, f"whole {whole.simpleString()}, kept string")
    return done.select(*(F.col("kept").alias(text) if c == text else F.col("whole").getField(c).alias(c) for c in docs.columns))
