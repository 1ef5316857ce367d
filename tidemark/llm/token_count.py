"""Token counts of whole texts by a map-side lookup in two tiers; no pre-token is shuffled.

The first tier is a broadcast hash table from frequent pre-tokens to their number of tokens. It has
at most ``table_size`` entries of at most 64 characters, whatever the corpus. It comes from about
``sample_docs`` rows and is only a cache: the counts don't depend on it. Each task counts its own rows of the
sample and hands over its most frequent pre-tokens, ``words_each`` for a row at most, so what all of them hand
to the driver has a bound too. Pre-tokens that the table lacks go
through a bounded cache of each Python worker, which encodes them with the tokenizer's own model.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import presplit, workspace


class Lengths:
    """Pre-splitting and pre-token lengths for a tokenizer file with word ends (lower case, white space dropped)."""

    def __init__(self, path: str, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        presplit.expect_file(path, presplit.WORD_LEVEL)
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalize = self.tokenizer.model, self.tokenizer.normalizer.normalize_str
        self.split = presplit.splitter(presplit.special_tokens(path))
        self.words = presplit.finder(presplit.ASCII_WORD_PATTERN, presplit.WORD_PATTERN)
        self.alphabet = presplit.byte_alphabet()
        self.cache = presplit.Cache(self.length, most)

    def length(self, word: str) -> int:
        return len(self.model.tokenize(word.encode("utf-8").decode("latin-1").translate(self.alphabet)))

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and its number of special strings."""
        parts = self.split(text)
        words: list[str] = []
        for part in parts[::2]:
            words += self.words(part.lower() if part.isascii() else self.normalize(part))
        return words, len(parts) // 2


@lru_cache(maxsize=2)
def lengths(path: str) -> Lengths:
    return Lengths(path)


def frequent(docs: DataFrame, tokenizer_path: str, text: str = "text", sample_docs: int = 4000, table_size: int = 1 << 16, words_each: int = 128, seed: int = 7) -> dict[str, int]:
    """The first tier: lengths of the most frequent short pre-tokens of about sample_docs rows. No pre-token is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts, n = lengths(tokenizer_path), Counter(), 0
        for b in batches:
            for t in b["t"].to_pylist():
                n += 1
                if t:
                    counts.update(w for w in own.pre_tokens(t)[0] if len(w) <= presplit.LONGEST_CACHED)
        top = counts.most_common(min(table_size, n * words_each))
        if top:
            yield pa.RecordBatch.from_pydict({"top": [[{"w": w, "c": c, "n": own.cache[w]} for w, c in top]]}, schema)

    schema = pa.schema([("top", pa.list_(pa.struct([("w", pa.string()), ("c", pa.int64()), ("n", pa.int32())])))])
    rows = docs.count()
    if not rows:
        return {}
    parts = docs.select(F.col(text).alias("t")).sample(min(1.0, sample_docs / rows), seed).mapInArrow(run, "top array<struct<w: string, c: long, n: int>>")
    counts, known = Counter(), {}
    for r in parts.collect():
        for w, c, n in r["top"]:
            counts[w] += c
            known[w] = n
    return {w: known[w] for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:table_size]}


def token_counts(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 2048, sample_docs: int = 4000, table_size: int = 1 << 16) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row.

    n_tokens is what the library gives for the whole text without added special tokens; special
    strings inside a text count as one token each. Null counts as empty: 0 bytes, 0 tokens. Repeated
    rows are counted each, rows without doc_id too; an empty table gives no rows; other columns are not read.
    """
    workspace.small_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, tokenizer_path, text, sample_docs, table_size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first = lengths(tokenizer_path), table.value.get
        for b in batches:
            n_bytes, n_tokens = [], []
            for t in b["t"].to_pylist():
                t = t or ""
                words, specials = own.pre_tokens(t)
                known = list(map(first, words))
                if None in known:
                    known = [own.cache[w] if n is None else n for w, n in zip(words, known)]
                n_tokens.append(specials + sum(known))
                n_bytes.append(len(t) if t.isascii() else len(t.encode("utf-8")))
            yield pa.RecordBatch.from_arrays([b["i"], pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
