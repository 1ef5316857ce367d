"""Operators on texts against brute force, over hard cases and over the small table."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe_automaton, exact_dedup, langid, records, simhash, suffix_dedup, suffix_sort, token_count, window_dedup

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
WORDS = re.compile(rb"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def library(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return t, [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def brute_components(ids, prints):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 62)
    for i, d in enumerate(ids):
        least[find(i)] = min(least[find(i)], d)
    return [least[find(i)] for i in range(len(ids))]


def brute_print(text):
    words = WORDS.findall((text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("table", ["docs", "small"])
def test_simhash(request, table):
    df = request.getfixturevalue(table)
    given_rows = rows(df)
    prints = [brute_print(t) for _, t in given_rows]
    expected = Counter(zip((d for d, _ in given_rows), (f"{p:016x}" for p in prints), brute_components([d for d, _ in given_rows], prints)))
    assert Counter(map(tuple, simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect())) == expected


def test_simhash_dense_keys_link_the_same(spark):
    """A group far over the dense limit, linked by flips, has the components of brute force; so has a chain."""
    rng = np.random.default_rng(0)
    base = int(rng.integers(0, 1 << 63))
    prints = {base ^ sum(1 << int(b) for b in rng.choice(np.arange(40, 64), rng.integers(0, 4), replace=False)) for _ in range(150)}
    prints |= {base ^ (1 << 30) ^ ((1 << k) - 1) for k in range(0, 30, 2)}
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "fp long, rep long")
    from tidemark.llm.components import components

    for dense in (4, 1000):
        found = dict(map(tuple, components(simhash.links(df, dense=dense), "a", "b").collect()))
        assert [found.get(i, i) for i in range(len(prints))] == brute_components(list(range(len(prints))), prints)


def test_ring_filter_loses_no_pair():
    """Whatever two bits differ, some slot has equal key bits and passes the chain test."""
    from itertools import combinations

    zero, *halves = simhash._masks(8, 2)
    turn = lambda x, i: (x >> 8 * i | x << 64 - 8 * i) & (1 << 64) - 1
    of = simhash.budgets(8, 2)
    for a, b in combinations(range(64), 2):
        diff = [turn(1 << a | 1 << b, i) for i in range(8)]
        assert any(d & (zero | h) == 0 and all((d & (1 << 8 * (k + 1)) - 1).bit_count() <= n for k, n in enumerate(of)) for d in diff for h in halves)


@pytest.mark.parametrize("table", ["docs", "small"])
def test_token_counts(request, table):
    df = request.getfixturevalue(table)
    given_rows = rows(df)
    _, ids = library(WORD, [t for _, t in given_rows])
    expected = Counter((d, len((t or "").encode()), len(x), len(x) > 2048) for (d, t), x in zip(given_rows, ids))
    for size in (1, 1 << 16):  # the first tier is only a cache
        assert Counter(map(tuple, token_count.token_counts(df, WORD, table_size=size).collect())) == expected


@pytest.mark.parametrize("table", ["docs", "small"])
def test_token_records(request, table, tmp_path, spark):
    df = request.getfixturevalue(table)
    given_rows = sorted(rows(df), key=lambda r: (r[0], r[1] or ""))
    _, ids = library(BYTE, [t for _, t in given_rows])
    at, expected = 0, []
    for (d, _), x in zip(given_rows, ids):
        x = np.array([*x, 0], "<u4")
        expected.append((d, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    shards = records.write_tokens(df, BYTE, f"file://{tmp_path}/out", target=100_000)
    assert sorted(map(tuple, records.read_tokens(spark, shards).collect()), key=lambda r: r[1]) == expected
    shard = records.Shard(shards[-1]["path"])
    k = len(shard) // 2
    assert shard.sequence(k).tolist() == list(shard.sequences())[k].tolist()
    path = shards[0]["path"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[14] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        list(records.Shard(shards[0]["path"]).sequences())


@pytest.mark.parametrize("table", ["docs", "small"])
def test_bpe_automaton(request, table):
    df = request.getfixturevalue(table)
    given_rows = rows(df)
    t, ids = library(BYTE, [x for _, x in given_rows])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = Counter((d, len(x), sha(np.array(x, "<u4").tobytes()), sha(t.decode(x, skip_special_tokens=False).encode())) for (d, _), x in zip(given_rows, ids))
    assert Counter(map(tuple, bpe_automaton.encode_decode(df, BYTE).collect())) == expected


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=25), st.text("abc", max_size=30))
def test_automaton_follows_any_merges(pairs, word):
    """Against merging by priority, with merge lists that no training would give."""
    labels, merges, known = [b"a", b"b", b"c"], [], {b"a": 0, b"b": 1, b"c": 2}
    seen = set()
    for u, v in pairs:
        u, v = u % len(labels), v % len(labels)
        made = labels[u] + labels[v]
        if made in known or (u, v) in seen:
            continue
        seen.add((u, v))
        known[made] = len(labels)
        labels.append(made)
        merges.append((u, v, known[made]))
    ids = [known[c.encode()] for c in word]
    while True:
        best = min(((k, i) for i in range(len(ids) - 1) for k, (u, v, _) in enumerate(merges) if (ids[i], ids[i + 1]) == (u, v)), default=None)
        if best is None:
            break
        u, v, w = merges[best[0]]
        out, i = [], 0
        while i < len(ids):
            hit = i + 1 < len(ids) and (ids[i], ids[i + 1]) == (u, v)
            out.append(w if hit else ids[i])
            i += 1 + hit
        ids = out
    assert np.frombuffer(bpe_automaton.Automaton(labels, merges).compile().path(word.encode()), "<u4").tolist() == ids


def test_language_id(small, docs, no_docs):
    held = [r for r in langid.identify(small).join(small.select("doc_id", "lang"), "doc_id").collect() if r["held_out"]]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    model = langid.fit(small)
    got = langid.predict(docs, model)
    assert got.columns == [c for c in docs.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    for r in got.collect():
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
        assert 0 <= r["score"] <= 1
    assert got.count() == docs.count() and langid.predict(no_docs, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.limit(0).union(docs)).collect()} <= {"en", "und"}
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(no_docs)).collect()} == {"und"}


def test_language_spans(spark):
    """A text of two languages splits where they meet; scripts decide alone where they can."""
    en, ru = "the cat sat with the dog and they ran home together", "кошка сидела рядом с собакой и они вместе бежали домой"
    model = langid.fit(spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([(en, "en"), (ru, "ru"), ("der Hund und die Katze liefen nach Hause zusammen", "de")] * 3)], "doc_id long, text string, lang string"))
    langs, scores, spans = langid.label_texts(model, [f"{en} {ru}", ru.upper(), "42 !", None], 12.0)
    assert [s["lang"] for s in spans[0]] == ["en", "ru"] and spans[0][0]["end"] == len(en.split()) and langs[1:] == ["ru", "und", "und"] and scores[1:] == [1.0, 0.0, 0.0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.lists(st.floats(-9, 0), min_size=3, max_size=3), max_size=6), min_size=1, max_size=4))
def test_viterbi(texts):
    """The labels reach the best total of all label sequences."""
    from itertools import product

    count = np.array([len(t) for t in texts])
    scores = np.array([w for t in texts for w in t]).reshape(-1, 3)
    for segment in (4096, 2, 1):
        label, at = langid.viterbi(scores, count, 2.0, segment), 0
        for n in count.tolist():
            total = lambda x, at=at, n=n: sum(scores[at + i, x[i]] for i in range(n)) - 2.0 * sum(x[i] != x[i - 1] for i in range(1, n))
            assert n == 0 or total(label[at : at + n]) >= max(map(total, product(range(3), repeat=n))) - 1e-6
            at += n


def test_viterbi_in_segments():
    """A long text in segments has the total of one run over all of it."""
    rng = np.random.default_rng(9)
    scores = np.repeat(rng.normal(0, 3, (60, 4)), 50, axis=0) + rng.normal(0, 2, (3000, 4))
    total = lambda x: scores[np.arange(3000), x].sum() - 12.0 * np.count_nonzero(np.diff(x))
    whole = total(langid.viterbi(scores, np.array([3000]), 12.0))
    for segment in (7, 64, 1000):
        assert abs(total(langid.viterbi(scores, np.array([3000]), 12.0, segment)) - whole) < 1e-6


def test_text_of_millions_of_words():
    import time

    rng = np.random.default_rng(1)
    words = {"en": "the cat sat with dog and they ran home together", "de": "der hund und die katze liefen nach hause zusammen"}
    model_ = langid.Model.fit(["de", "en"], *_counts([words["de"], words["en"]]))
    parts = [" ".join(rng.choice(words[x].split(), n)) for x, n in (("en", 700_000), ("de", 800_000), ("en", 600_000))]
    began = time.time()
    langs, scores, spans = langid.label_texts(model_, [" ".join(parts), parts[1]], 12.0)
    assert time.time() - began < 60 and langs == ["en", "de"] and scores[1] == 1.0
    assert [s["lang"] for s in spans[0]] == ["en", "de", "en"] and abs(spans[0][0]["end"] - 700_000) < 5 and spans[0][-1]["end"] == 2_100_000


def _counts(texts):
    counts, letters = np.zeros((len(texts), 2, langid.SIZE)), np.zeros((len(texts), len(langid.SCRIPTS)))
    for k, t in enumerate(texts):
        w = langid.words_of([t])
        counts[k, 0] += np.bincount(w.pair, minlength=langid.SIZE)
        counts[k, 1] += np.bincount(w.triple, minlength=langid.SIZE)
        letters[k] += np.bincount(w.script, w.length, minlength=len(langid.SCRIPTS))
    return counts, letters


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(s):
    s = [*s, 0]
    assert suffix_sort.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(c % 3 for c in b)), max_size=5), st.integers(1, 5))
def test_repeated_windows(fragments, width):
    times = Counter(f[i : i + width] for f in fragments for i in range(len(f) - width + 1))
    expected = [[i for i in range(len(f) - width + 1) if times[f[i : i + width]] > 1] for f in fragments]
    assert [sorted(x) for x in suffix_sort.repeated_windows(fragments, width)] == expected


def brute_suffix(given_rows, width):
    data = [(d, (t or "").encode()) for d, t in given_rows]
    times = Counter(b[i : i + width] for _, b in data for i in range(len(b) - width + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - width + 1):
            if times[b[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("how", [{}, {"target": 50_000}, {"dense": 0}, {"dense": 1, "target": 50_000}, {"sort_bytes": 1}, {"bits": 4, "target": 50_000}, {"bits": 3, "dense": 0}])
def test_suffix_dedup(docs, how):
    """Also where nearly all hashes collide."""
    assert Counter(map(tuple, suffix_dedup.remove_repeats(docs, **how).collect())) == brute_suffix(rows(docs), 200)


def test_suffix_dedup_common_passage(spark):
    """One passage in most documents, between different ones, by sorting and by the path for dense anchors."""
    import random

    rng = random.Random(1)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(260)
    given_rows = [(i, noise(rng.randint(0, 300)) + passage[rng.randint(0, 30) :] + noise(rng.randint(0, 300))) for i in range(60)]
    df = spark.createDataFrame(given_rows, "doc_id long, text string")
    for dense in (5, 512):
        assert Counter(map(tuple, suffix_dedup.remove_repeats(df, dense=dense, target=5000).collect())) == brute_suffix(given_rows, 200)


def test_suffix_dedup_texts(docs, no_docs):
    cut = suffix_dedup.remove_repeats(docs, texts=True)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    other = [c for c in docs.columns if c != "text"]
    assert Counter(map(tuple, cut.select(other).collect())) == Counter(map(tuple, docs.select(other).collect()))
    assert suffix_dedup.remove_repeats(no_docs).count() == 0 and suffix_dedup.remove_repeats(no_docs, texts=True).count() == 0


def brute_windows(given_rows, width):
    words = [(d, WORDS.findall((t or "").encode())) for d, t in given_rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("how", [{}, {"target": 50_000}, {"bits": 3, "target": 50_000}, {"bits": 5}])
def test_window_dedup(docs, no_docs, how):
    """Also where nearly all window hashes collide."""
    got = window_dedup.remove_repeats(docs, **how)
    assert Counter(map(tuple, got.drop("intervals").collect())) == brute_windows(rows(docs), 50)
    assert all(sum(i["end"] - i["first"] for i in r["intervals"]) == r["n_removed"] for r in got.collect())
    assert window_dedup.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("table", ["docs", "small"])
def test_exact_dedup(request, table):
    df = request.getfixturevalue(table)
    norm = [(d, re.sub(r"[\x20\x09-\x0d]+", " ", t or "")) for d, t in rows(df)]
    groups = defaultdict(list)
    for d, t in norm:
        groups[t].append(d)
    expected = Counter((d, min(groups[t]), len(groups[t]), d == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in norm)
    assert Counter(map(tuple, exact_dedup.exact_duplicates(df).collect())) == expected


def test_chunks_spell_the_text(docs):
    from pyspark.sql import functions as F

    text = exact_dedup.normalised(F.col("text"))
    for r in docs.select(text.alias("t"), exact_dedup.content_chunks(text).alias("c")).collect():
        assert "".join(r["c"]).encode("latin-1") == r["t"].encode() and all(0 < len(x) <= 4101 for x in r["c"])


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz     ", "АБВГДЕЖабвгдежзиклмнопрст   ", "日本語のテキスト中文字漢學校時間", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef", "ACGT", "{}();=<> \n\tifxyn0"])
def test_chunks_follow_the_content(spark, alphabet):
    """In any script, code or numbers a character put in front moves the cuts near it alone."""
    import random

    from pyspark.sql import functions as F

    text = "".join(random.Random(6).choices(alphabet, k=40_000))
    df = spark.createDataFrame([(text,), ("x" + text,), (text[:20_000] + "yz" + text[20_000:],)], "t string")
    plain, front, middle = (set(r["c"]) for r in df.select(exact_dedup.content_chunks(F.col("t")).alias("c")).collect())
    assert len(plain) > 12 and len(plain - front) <= 4 and len(plain - middle) <= 4, (len(plain), len(plain - front), len(plain - middle))


def test_empty_tables(no_docs):
    for df in (simhash.near_duplicates(no_docs), token_count.token_counts(no_docs, WORD), records.token_files(no_docs, BYTE), bpe_automaton.encode_decode(no_docs, BYTE), langid.identify(no_docs), exact_dedup.exact_duplicates(no_docs)):
        assert df.count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, None), (3, "a b c d")], "doc_id long, text string")
    assert {tuple(r) for r in exact_dedup.exact_duplicates(df).select("doc_id", "keep_id", "group_size", "kept").collect()} == {(None, 3, 2, False), (None, None, 1, False), (3, 3, 2, True)}
    assert sorted((r["component_id"] or -1) for r in simhash.near_duplicates(df).collect()) == [-1, 3, 3]
    assert records.token_files(df, BYTE).orderBy("start").first()["doc_id"] is None
    for got in (window_dedup.remove_repeats(df), suffix_dedup.remove_repeats(df)):
        assert sorted((r["doc_id"] is None for r in got.collect())) == [False, True, True]


def test_chunks_of_a_hot_id(spark):
    """Rows of one id, or without one, spread over several chunks, still in order."""
    from tidemark.llm import blocks

    texts = [(5 if i % 3 else None if i % 2 else i, f"{i} " * 50) for i in range(600)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "xxhash64(text) AS hash")
    cut, n = blocks.chunked(df, "doc_id", "text", 4000, split="hash")
    got = sorted((r["chunk"], -(1 << 63) if r["doc_id"] is None else r["doc_id"], r["hash"]) for r in cut.collect())
    assert [g[1:] for g in got] == sorted(g[1:] for g in got) and len({g[0] for g in got if g[1] == 5}) >= 4 and max(Counter(g[0] for g in got).values()) < 200 and got[-1][0] < n


def test_more_chunks_than_ranges(spark, monkeypatch):
    from tidemark.llm import blocks

    monkeypatch.setattr(blocks, "_RANGES", 4)
    df = spark.range(3000).selectExpr("id * 7 AS doc_id", "repeat('x', 100) AS text")
    cut, n = blocks.chunked(df, "doc_id", "text", 10_000)
    got = [r["chunk"] for r in cut.orderBy("doc_id").collect()]
    assert got == sorted(got) and 16 <= len(set(got)) <= n and max(Counter(got).values()) < 250


def test_large_ids_beside_null(spark):
    """Ids above 2**53 come back as they are, whoever their neighbours are."""
    given_ids = {9007199254740993: "a b c d", 9007199254740995: "e f", None: "g"}
    df = spark.createDataFrame([(i, t) for i, t in given_ids.items()], "doc_id long, text string").coalesce(1)
    for got in (simhash.near_duplicates(df), token_count.token_counts(df, WORD), bpe_automaton.encode_decode(df, BYTE), records.token_files(df, BYTE), window_dedup.remove_repeats(df), suffix_dedup.remove_repeats(df), exact_dedup.exact_duplicates(df), records.lengths(df, BYTE)):
        assert {r["doc_id"] for r in got.collect()} == set(given_ids)
    marked = langid.identify(df.selectExpr("doc_id", "text", "'en' AS lang"))
    assert {r["doc_id"] for r in marked.collect()} == set(given_ids)


def test_rows_without_id_count(spark):
    rows_ = [(None, "İΣß <|endoftext|> end"), (None, None), (4, "one two")]
    df = spark.createDataFrame(rows_, "doc_id long, text string").coalesce(1)
    for path, got in ((WORD, token_count.token_counts(df, WORD)), (BYTE, bpe_automaton.encode_decode(df, BYTE))):
        _, ids = library(path, [t for _, t in rows_])
        assert Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == Counter((d, len(x)) for (d, _), x in zip(rows_, ids))


@pytest.mark.parametrize("operator", [token_count.token_counts, bpe_automaton.encode_decode, records.lengths])
def test_other_tokenizer_files_are_refused(spark, operator):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(Exception, match="not of the kind"):
        operator(df, BYTE if operator is token_count.token_counts else WORD).collect()


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
