"""Token sequences in length-delimited binary records, with a separate index for shuffled reads.

A shard file is a run of records, each
    8 bytes  length of the payload, little-endian
    4 bytes  masked checksum of those 8 bytes
    payload  token ids, little-endian, of 2 bytes each (4 if the vocabulary needs them)
    4 bytes  masked checksum of the payload
where a checksum is CRC-32, rotated right by 15 bits plus a constant, so that a checksum stored inside
data isn't mistaken for one of it. Beside it lies an index file with a head (magic, bytes per id, number of records)
and three columns of 64-bit integers: doc_id, offset of the record, number of ids. Shards are
ranges of doc_id in ascending order. A task writes its shard under a name of its own and renames it,
so a task that runs again or twice does no harm.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import blocks, presplit, workspace

MAGIC = b"TIDEREC1"
_HEAD = "<8sqq"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> list[bytes]:
    size = struct.pack("<Q", len(payload))
    return [size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))]


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the record at an offset, and the offset after it; ValueError if either checksum is wrong."""
    size = bytes(data[at : at + 8])
    n = struct.unpack("<Q", size)[0] if len(size) == 8 else 0
    if len(data) < at + 16 + n or struct.unpack_from("<I", data, at + 8)[0] != masked(size):
        raise ValueError(f"broken record head at byte {at}")
    payload = data[at + 12 : at + 12 + n]
    if struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
        raise ValueError(f"broken record at byte {at}")
    return payload, at + 16 + n


def _store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


def _write(uri: str, parts: Iterable[bytes]) -> None:
    fs, path = _store(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        for part in parts:
            f.write(part)
    fs.move(own, path)


class Shard:
    """Random access to the sequences of one shard through its index."""

    def __init__(self, uri: str):
        self.fs, self.path = _store(uri)
        with self.fs.open_input_file(f"{self.path}.idx") as f:
            raw = f.read()
        magic, self.width, n = struct.unpack_from(_HEAD, raw)
        if magic != MAGIC:
            raise ValueError(f"{uri}.idx is no index")
        self.doc_ids, self.offsets, self.counts = np.frombuffer(raw, "<i8", 3 * n, struct.calcsize(_HEAD)).reshape(3, n)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, payload: memoryview) -> np.ndarray:
        return np.frombuffer(payload, f"<u{self.width}")

    def sequence(self, i: int) -> np.ndarray:
        with self.fs.open_input_file(self.path) as f:
            data = memoryview(f.read_at(16 + int(self.counts[i]) * self.width, int(self.offsets[i])))
        return self.ids(unframe(data, 0)[0])

    def sequences(self) -> Iterator[np.ndarray]:
        with self.fs.open_input_file(self.path) as f:
            data, at = memoryview(f.read()), 0
        for _ in range(len(self)):
            payload, at = unframe(data, at)
            yield self.ids(payload)
        if at != len(data):
            raise ValueError(f"{self.path} goes on after its last record")


class Encoder:
    """A byte-level tokenizer file, its model run once for each distinct pre-token of a worker's cache."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        presplit.expect_file(path, presplit.BYTE_LEVEL)
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.alphabet = self.tokenizer.model, presplit.byte_alphabet()
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.specials = presplit.special_tokens(path)
        self.split, self.words = presplit.splitter(self.specials), presplit.finder(presplit.ASCII_BYTE_PATTERN, presplit.BYTE_PATTERN)
        self.cache = presplit.Cache(self.encode_word, 800_000)
        self.sizes = presplit.Cache(lambda word: len(self.model.tokenize(word.encode("utf-8").decode("latin-1").translate(self.alphabet))), 400_000)

    def encode_word(self, word: str) -> bytes:
        pieces = self.model.tokenize(word.encode("utf-8").decode("latin-1").translate(self.alphabet))
        return np.array([p.id for p in pieces], f"<u{self.width}").tobytes()

    def encode(self, text: str) -> bytes:
        out, cache = [], self.cache
        for k, part in enumerate(self.split(text)):
            out += [self.specials[part].to_bytes(self.width, "little")] if k % 2 else map(cache.__getitem__, self.words(part))
        return b"".join(out)

    def count(self, text: str) -> int:
        """The number of ids that encode() gives."""
        parts, size = self.split(text), self.sizes.__getitem__
        return len(parts) // 2 + sum(sum(map(size, self.words(part))) for part in parts[::2])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = 0, target: int = blocks.TARGET) -> list[dict]:
    """Encode every row and write the shards to a folder; returns for each shard its path, documents and ids, in order.

    Rows go in ascending doc_id (null first, equal ids by a hash of their text, so many rows of one id, or without one, spread
    over chunks). Null counts as empty, so it has the end id alone. Repeated rows are written each. An empty table gives no
    shards. The list has one entry for each chunk (see blocks), about three million at 100 TB.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("hash"))
    rows, _ = blocks.chunked(rows, "doc_id", "text", target, split="hash")

    def write(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("hash", "ascending"), ("text", "ascending")])
        own, chunk = encoder(tokenizer_path), t["chunk"][0].as_py()
        first = pa.compute.is_null(t["doc_id"]).to_numpy(zero_copy_only=False)
        t = t.take(np.argsort(~first, kind="stable"))
        end = b"" if end_id is None else end_id.to_bytes(own.width, "little")
        offsets, counts, at = [], [], 0

        def framed() -> Iterator[bytes]:
            nonlocal at
            for first in range(0, t.num_rows, 500):
                parts = []
                for x in t["text"].slice(first, 500).to_pylist():
                    payload = own.encode(x or "") + end
                    offsets.append(at)
                    counts.append(len(payload) // own.width)
                    at += 16 + len(payload)
                    parts += frame(payload)
                yield b"".join(parts)

        uri = f"{folder}/shard-{chunk:08d}.rec"
        ids = pa.compute.fill_null(t["doc_id"], -(1 << 63)).to_numpy()
        _write(uri, framed())
        _write(f"{uri}.idx", [struct.pack(_HEAD, MAGIC, own.width, len(offsets)), np.array([ids, offsets, counts], "<i8").tobytes()])
        return pa.table({"shard": pa.array([chunk], pa.int32()), "path": [uri], "docs": pa.array([len(offsets)], pa.int64()), "ids": pa.array([sum(counts)], pa.int64())})

    done = rows.groupBy("chunk").applyInArrow(write, "shard int, path string, docs long, ids long")
    return sorted((r.asDict() for r in done.collect()), key=lambda r: r["shard"])


def lengths(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) for every row: its ids as write_tokens() writes them, the end id counted; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workspace.give_back()
        own = encoder(tokenizer_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["i"], pa.array([own.count(t or "") + 1 for t in b["t"].to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    workspace.small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).mapInArrow(run, "doc_id long, n_tokens long")


def read_tokens(spark, shards: list[dict], keep: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record in the files, checksums verified; with keep also ids.

    start counts the ids of all records before it.
    """
    starts = np.concatenate(([0], np.cumsum([s["ids"] for s in shards]))).tolist()
    todo = spark.createDataFrame([(s["path"], x) for s, x in zip(shards, starts)], "path string, start long").repartition(max(1, len(shards)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, start in zip(b["path"], b["start"]):
                shard = Shard(path)
                begins = start + np.cumsum(shard.counts) - shard.counts
                ids = pd.array(shard.doc_ids, dtype="Int64")
                ids[shard.doc_ids == -(1 << 63)] = pd.NA
                crcs, seqs, lens = [], [], []
                for x in shard.sequences():
                    crcs.append(zlib.crc32(x.astype("<u4").tobytes()))
                    lens.append(len(x))
                    if keep:
                        seqs.append(x.astype(np.int32))
                yield pd.DataFrame({"doc_id": ids, "start": begins, "n_tokens": lens, "ids_crc32": crcs} | ({"ids": seqs} if keep else {}))

    return todo.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep)


def token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int | None = 0, target: int = blocks.TARGET) -> DataFrame:
    """write_tokens() to a folder (one in the shared scratch space if None), then read_tokens() from it."""
    folder = folder or workspace.new_path(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, write_tokens(docs, tokenizer_path, folder, doc_id, text, end_id, target))
