"""Language identification of whole texts: script ranges, word scores, Viterbi with a switching penalty.

A word is a run of letters. Its script, from fixed ranges of code points, leaves as candidates the
languages that were seen with that script; a script never seen narrows nothing. Each candidate scores the
word by its letter pairs and triples under a multinomial model. Viterbi over the words of a text, with a
penalty for each change of language, labels spans. The prediction is the language with the most
letters, its share of all letters is the score.

The model has two fixed tables of 2**16 hashed features for each language, whatever the corpus, so it can be
broadcast. It is fitted on about ``docs_per_lang`` labelled rows of each language (the documented bound).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import blocks, workspace

UNDETERMINED = "und"
SIZE = 1 << 16
#: Characters whose features are held at once, and characters of the texts that go through Viterbi side by side.
_SLICE, _TOGETHER = 1 << 18, 1 << 21
#: Words of a long text that go through Viterbi as one.
_SEGMENT = 4096
#: First and last code point, and script.
SCRIPT_RANGES = [
    (0x0041, 0x024F, "Latin"), (0x0250, 0x02AF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"),
    (0x0531, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"), (0x0B80, 0x0BFF, "Tamil"),
    (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"), (0x0E00, 0x0E7F, "Thai"),
    (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"),
    (0x3040, 0x30FF, "Kana"), (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"), (0xFB50, 0xFDFF, "Arabic"),
]
SCRIPTS = ["Other", *dict.fromkeys(s for _, _, s in SCRIPT_RANGES)]

_table: np.ndarray | None = None


def script_table() -> np.ndarray:
    """For each code point 0 if it is no letter, else 1 + the number of its script."""
    global _table
    if _table is None:
        table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint8, 0x110000)
        for first, last, script in SCRIPT_RANGES:
            table[first : last + 1] *= np.uint8(1 + SCRIPTS.index(script))
        _table = table
    return _table


def parted(text: str) -> list[str]:
    """A long text in parts of about _SLICE characters that end at a space or line feed, so no word is cut."""
    out, at = [], 0
    while len(text) - at > _SLICE:
        ends = [x for x in (text.rfind(c, at, at + _SLICE) for c in " \n") if x >= 0] or [x for x in (text.find(c, at + _SLICE) for c in " \n") if x >= 0]
        if not ends:
            break
        end = (max if min(ends) < at + _SLICE else min)(ends) + 1
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


@dataclass
class Words:
    """The words of several texts: per letter its two features, per word where it begins, its length, script and text."""

    pair: np.ndarray
    triple: np.ndarray
    start: np.ndarray
    length: np.ndarray
    script: np.ndarray
    count: np.ndarray


def words_of(texts: list[str]) -> Words:
    lower = [t.lower() for t in texts]
    cp = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    script = script_table()[cp]
    letter = script > 0
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.flatnonzero(letter)
    ends = np.cumsum([len(t) + 1 for t in lower]) if lower else np.zeros(0, np.int64)
    c = np.where(letter, cp, 0).astype(np.uint64)
    before, after = np.concatenate((np.zeros(1, np.uint64), c[:-1]))[at], np.concatenate((c[1:], np.zeros(1, np.uint64)))[at]
    here = c[at]
    feature = lambda x: (blocks.mix(x) >> np.uint64(48)).astype(np.int64)
    pair = feature(here << np.uint64(21) | after)
    triple = feature(before << np.uint64(42) | here << np.uint64(21) | after | np.uint64(1 << 63))
    length = last - first
    begin = np.concatenate(([0], np.cumsum(length)[:-1])).astype(np.int64) if len(length) else length
    count = np.diff(np.searchsorted(first, ends), prepend=0)
    return Words(pair, triple, begin, length, script[first].astype(np.int64) - 1, count)


@dataclass
class Model:
    langs: list[str]
    pair: np.ndarray = field(repr=False)
    triple: np.ndarray = field(repr=False)
    scripts: np.ndarray = field(repr=False)

    @classmethod
    def fit(cls, langs: list[str], counts: np.ndarray, letters: np.ndarray, smooth: float = 0.5) -> Model:
        """counts: language x 2 x feature; letters: language x script."""
        logs = np.log((counts + smooth) / (counts.sum(axis=2, keepdims=True) + smooth * SIZE)).astype(np.float32)
        share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
        return cls(langs, logs[:, 0], logs[:, 1], share >= 0.01)

    def scores(self, w: Words) -> np.ndarray:
        """Word x language; languages that a word's script rules out score far below."""
        out = np.empty((len(w.start), len(self.langs)), np.float32)
        for k in range(len(self.langs)):
            out[:, k] = np.add.reduceat(self.pair[k][w.pair] + self.triple[k][w.triple], w.start) if len(w.start) else 0
        seen = self.scripts.any(axis=0)
        ruled_out = seen[w.script][:, None] & ~self.scripts.T[w.script]
        out[ruled_out] -= 1e4
        return out


class _Steps:
    """Viterbi over segments of words side by side, with the way back of each word in two flat tables."""

    def __init__(self, scores: np.ndarray, at: np.ndarray, n: np.ndarray, penalty: float):
        self.scores, self.at, self.n, self.penalty = scores, at, n, penalty
        self.stay, self.came = np.ones(scores.shape, bool), np.zeros(len(scores), np.int16)

    def _live(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """rows, the longest first; where they begin; how many have a word at each step."""
        rows = rows[np.argsort(-self.n[rows], kind="stable")]
        n = self.n[rows]
        return rows, self.at[rows], np.searchsorted(-n, -np.arange(1, int(n[0]) + 1), side="right")

    def forward(self, rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The totals of each language after the last word of the rows, from the totals before their first."""
        order, at, live = self._live(rows)
        place = np.empty(len(self.n), np.int64)
        place[rows] = np.arange(len(rows))
        best = start[place[order]]
        for t, d in enumerate(live.tolist()):
            now, word = best[:d], at[:d] + t
            top = now.argmax(axis=1)
            jump = now[np.arange(d), top][:, None] - self.penalty
            stay = now >= jump
            self.stay[word], self.came[word] = stay, top
            best[:d] = np.where(stay, now, jump) + self.scores[word]
        out = np.empty_like(best)
        out[place[order]] = best
        return out

    def back(self, rows: np.ndarray, ends: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
        """From the language of each row's last word (of one way or several) to that before its first; label gets those between."""
        order, at, live = self._live(rows)
        place = np.empty(len(self.n), np.int64)
        place[rows] = np.arange(len(rows))
        now = ends[place[order]]
        for t in range(len(live) - 1, -1, -1):
            d = live[t]
            word, on = at[:d] + t, now[:d]
            if label is not None:
                label[word] = on
                now[:d] = np.where(self.stay[word, on], on, self.came[word])
            else:
                now[:d] = np.where(self.stay[word[:, None], on], on, self.came[word][:, None])
        out = np.empty_like(now)
        out[place[order]] = now
        return out


def viterbi(scores: np.ndarray, count: np.ndarray, penalty: float, segment: int = _SEGMENT) -> np.ndarray:
    """The best language of each word; count has the number of words of each text.

    Texts advance side by side, and so do the segments of a long text: each is first run as if it began the text, then again from
    the totals that the one before it ended with, until these no longer change. As a switch costs the same from anywhere, they
    soon don't. Memory is a byte for each word and language, and time for a text of millions of words that of one segment.
    """
    label = np.zeros(len(scores), np.int16)
    if not len(scores):
        return label
    k, parts = scores.shape[1], -(-count // segment)
    index = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    at = np.repeat(np.cumsum(count) - count, parts) + index * segment
    steps = _Steps(scores, at, np.minimum(segment, np.repeat(count, parts) - index * segment), penalty)
    start, end, todo, later = np.zeros((len(at), k)), np.zeros((len(at), k)), np.arange(len(at)), np.flatnonzero(index)
    while len(todo):
        end[todo] = steps.forward(todo, start[todo])
        fresh = end[later - 1] - end[later - 1].max(axis=1, keepdims=True)
        moved = (np.abs(fresh - start[later]) > 1e-9).any(axis=1)
        todo = later[moved]
        start[todo] = fresh[moved]
    last = end.argmax(axis=1)
    if len(later):
        ways = steps.back(later, np.tile(np.arange(k), (len(later), 1)))
        for j in range(len(later) - 1, -1, -1):
            last[later[j] - 1] = ways[j, last[later[j]]]
    steps.back(np.arange(len(at)), last, label)
    return label


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def highest_hash(wanted: float, rows: int) -> int:
    """The largest signed 64-bit hash that is still picked, so that about ``wanted`` of ``rows`` rows are."""
    return max(1, int(wanted / rows * 2**64)) - 2**63 - 1 if wanted < rows else 2**63 - 1


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_lang: float = 3000, max_langs: int = 500) -> Model:
    """Learn from the rows with text and lang, about docs_per_lang of each language, picked by a hash of ``key`` (of the text if null).

    Raises if there are more than max_langs languages, the bound of the model's size, or if the sample of a language
    comes out empty. No labelled rows: a model of no language.
    """
    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"), F.when(F.col(key).isNull(), F.xxhash64(F.col(text))).otherwise(F.xxhash64(F.col(key))).alias("s"))
    have = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).limit(max_langs + 1).collect()}
    if len(have) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    langs = sorted(have)
    if not langs:
        return Model([], np.zeros((0, SIZE)), np.zeros((0, SIZE)), np.zeros((0, len(SCRIPTS)), bool))
    picked = F.lit(False)
    for x in langs:
        picked = picked | ((F.col("l") == x) & (F.col("s") <= highest_hash(docs_per_lang, have[x])))
    width = 2 * SIZE + len(SCRIPTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, learned = np.zeros((len(langs), width), np.int64), np.zeros(len(langs), np.int64)
        for b in batches:
            texts, labels = b["t"].to_pylist(), b["l"].to_pylist()
            learned += np.bincount([langs.index(x) for x in labels], minlength=len(langs)).astype(np.int64)
            pieces = [(p, langs.index(x)) for t, x in zip(texts, labels) for p in parted(t)]
            for s, e in blocks.slices([len(p) for p, _ in pieces], _SLICE):
                w = words_of([p for p, _ in pieces[s:e]])
                of_word = np.repeat([x for _, x in pieces[s:e]], w.count)
                of_letter = np.repeat(of_word, w.length)
                for shift, f in ((0, w.pair), (SIZE, w.triple)):
                    total += np.bincount(of_letter * width + shift + f, minlength=total.size).reshape(total.shape)
                total += np.bincount(of_word * width + 2 * SIZE + w.script, w.length, minlength=total.size).reshape(total.shape).astype(np.int64)
        total = np.concatenate((total, learned[:, None]), axis=1)
        k, f = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(total[k, f])], ["k", "f", "n"])

    counts = np.zeros((len(langs), width + 1))  # the last column: rows of the sample
    found = rows.filter(picked).select("t", "l").mapInArrow(count, "k int, f int, n long").groupBy("k", "f").agg(F.sum("n").alias("n")).toArrow()
    counts[found["k"].to_numpy(), found["f"].to_numpy()] = found["n"].to_numpy()
    if not counts[:, -1].all():
        raise ValueError(f"no row in the sample of {[x for x, n in zip(langs, counts[:, -1]) if not n][:10]}")
    return Model.fit(langs, counts[:, : 2 * SIZE].reshape(len(langs), 2, SIZE), counts[:, 2 * SIZE : -1])


def label_texts(model: Model, texts: list[str | None], penalty: float) -> tuple[list[str], list[float], list[list[dict]]]:
    """Prediction, score and spans (language, first word, end) of each text."""
    texts = [t or "" for t in texts]
    langs, shares, spans = [UNDETERMINED] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    for s, e in blocks.slices([len(texts[i]) for i in order], _TOGETHER) if model.langs else []:
        cut = [parted(texts[i]) for i in order[s:e]]
        own, parts = [p for x in cut for p in x], []
        for a, b in blocks.slices([len(t) for t in own], _SLICE):
            w = words_of(own[a:b])
            parts.append((model.scores(w), w.count, w.length))
        scores, count, length = (np.concatenate(x) for x in zip(*parts))
        count = np.add.reduceat(count, np.cumsum([0, *map(len, cut)])[:-1])
        if not len(scores):
            continue
        label = viterbi(scores, count, penalty)
        doc = np.repeat(np.arange(e - s), count)
        k = len(model.langs)
        letters = np.bincount(doc * k + label, length, (e - s) * k).reshape(e - s, k)
        total, top = letters.sum(axis=1), letters.argmax(axis=1)
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])))
        at, word = np.flatnonzero(new), np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        size = np.diff(np.append(at, len(doc)))
        for d, x, first, n in zip(doc[at].tolist(), label[at].tolist(), word[at].tolist(), size.tolist()):
            spans[order[s + d]].append({"lang": model.langs[x], "first": first, "end": first + n})
        for d in np.flatnonzero(total > 0).tolist():
            langs[order[s + d]], shares[order[s + d]] = model.langs[top[d]], float(letters[d, top[d]] / total[d])
    return langs, shares, spans


def predict(docs: DataFrame, model: Model, text: str = "text", penalty: float = 12.0, lang_pred: str = "lang_pred", score: str = "score", spans: str | None = None) -> DataFrame:
    """docs with lang_pred, score and, if named, the spans; all other columns and rows as they are.

    ``und`` with score 0 for a text that is null or has no letter, and for all texts if the
    model knows no language. Ties go to the language first in order. A column of docs with the name of a new one
    is replaced. An empty table gives no rows.
    """
    workspace.small_batches(docs.sparkSession)
    given = docs.drop(lang_pred, score, *([spans] if spans else []))
    at, shared = given.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            langs, shares, runs = label_texts(own, b.column(at).to_pylist(), penalty)
            more = [pa.array(langs, pa.string()), pa.array(shares, pa.float64())]
            if spans:
                more.append(pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))))
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, lang_pred, score, *([spans] if spans else [])])

    more = [(lang_pred, "string"), (score, "double"), *([(spans, "array<struct<lang: string, first: int, end: int>>")] if spans else [])]
    schema = T.StructType([*given.schema.fields, *(T.StructField(n, T._parse_datatype_string(k)) for n, k in more)])
    return given.mapInArrow(run, schema)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_lang: int = 3000, penalty: float = 12.0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; learns only from labelled rows that aren't held out."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), held_out(F.col(doc_id)).alias("held_out"))
    model = fit(rows.filter(~F.col("held_out")), "text", "lang", "doc_id", docs_per_lang)
    return predict(rows.select("doc_id", "held_out", "text"), model, penalty=penalty).select("doc_id", "held_out", "lang_pred", "score")
