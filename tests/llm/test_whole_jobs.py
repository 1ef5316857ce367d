"""What the stages and the samples once left out."""

import random

import corpus_pipeline
import public_tokenizers
import pytest

from tidemark.llm import langid, queries, shingle_dedup, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def near_copies(rng, groups):
    """Texts of 150 words, each with a few copies in which one to four words differ."""
    out = []
    for _ in range(groups):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(150)]
        out.append(" ".join(words))
        for _ in range(3):
            other = list(words)
            for at in rng.sample(range(150), rng.randint(1, 4)):
                other[at] = f"x{rng.randint(0, 10**6)}"
            out.append(" ".join(other))
    return out


def brute(texts):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and similarity(texts[i], texts[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


@pytest.mark.parametrize("block", [256, 3])
def test_near_stage_finds_similar_texts(spark, block):
    """Components are those of brute force at 5 words and 0.8, also where bands are dense; pairs at 0.8 to 0.95 are among them."""
    texts = near_copies(random.Random(1), 40) + ["only four words here", "ONLY four  words here", "only four words there"]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 0.8 <= similarity(texts[i], texts[j]) <= 0.95]
    assert len(pairs) > 50
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    found = dict(map(tuple, shingle_dedup.near_components(df, "row", block=block).collect()))
    assert [found.get(i, i) for i in range(len(texts))] == brute(texts)


def test_long_texts_are_alike_by_their_least_shingles():
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(6000)]
    for share, expected in ((0.01, True), (0.3, False)):
        other = [f"x{rng.randint(0, 10**6)}" if rng.random() < share else w for w in words]
        x, y = (shingle_dedup.bottom(shingle_dedup.shingles(" ".join(t))) for t in (words, other))
        assert shingle_dedup.alike(x, y, 0.8) == expected


def test_near_stage_keeps_one_of_each(spark):
    texts = near_copies(random.Random(2), 20)
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in enumerate(texts)], SCHEMA)
    assert {r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()} == set(brute(texts))


def test_stages_keep_rows_without_id(spark):
    """One row of each group stays, with an id if any has one; unique texts without id stay."""
    a, b, c, d = near_copies(random.Random(3), 4)[::4]
    rows = [(None, a), (None, a.replace(" ", "  ")), (None, b), (None, b), (4, c), (None, c), (3, c), (None, d), (5, d + " more")]
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in rows], SCHEMA).repartition(2)
    once = corpus_pipeline.exact(spark, docs, "")
    kept = [(r["doc_id"], " ".join(r["text"].split())) for r in once.collect()]
    assert sorted(kept, key=str) == sorted([(None, a), (None, b), (3, c), (None, d), (5, d + " more")], key=str)
    kept = [(r["doc_id"], " ".join(r["text"].split())) for r in corpus_pipeline.near(spark, once, "").collect()]
    assert sorted(kept, key=str) == sorted([(None, a), (None, b), (3, c), (5, d + " more")], key=str)


def test_lengths_are_tokens(spark):
    """Texts without spaces and special strings count as the library counts them, and one end mark."""
    from tokenizers import Tokenizer

    texts = ["one two", "日本語のテキスト" * 400, "a" * 9000, "İΣß <|endoftext|>   end", "", None]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = dict(map(tuple, queries.word_lengths(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()))
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_sample_of_huge_language():
    for rows in (1, 10**4, 10**10, 10**13):
        picked = langid.highest_hash(3000, rows) + 2**63 + 1
        assert abs(picked / 2**64 - min(1, 3000 / rows)) <= 1e-6 * 3000 / rows


def test_empty_sample_raises(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'the cat and the dog' AS text", "'en' AS lang")
    with pytest.raises(ValueError, match="sample"):
        langid.fit(docs, docs_per_lang=1e-9)


def test_sample_of_rows_without_id(spark):
    docs = spark.range(2000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('the cat and dog ', id) AS text", "'en' AS lang")
    assert langid.fit(docs, docs_per_lang=200).langs == ["en"]


def test_near_stage_goes_through_fingerprints(spark, monkeypatch):
    """Rows whose 5-word fingerprints differ in two bits at most meet by their ring keys, are verified, and meet in no band again; bands find the others."""
    texts = near_copies(random.Random(4), 30)
    texts += [t + " zz" for t in texts[:20]]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    seen = {"links": 0, "starred": set()}
    links, close = simhash.links, shingle_dedup._close

    def counted(prints, *args, **kwargs):
        seen["links"] += 1
        return links(prints, *args, **kwargs)

    def starred(pairs, *args):
        seen["starred"] |= {tuple(sorted(p)) for p in pairs.collect()}
        return close(pairs, *args)

    monkeypatch.setattr(simhash, "links", counted)
    monkeypatch.setattr(shingle_dedup, "_close", starred)
    found = dict(map(tuple, shingle_dedup.near_components(df, "row").collect()))
    assert [found.get(i, i) for i in range(len(texts))] == brute(texts)
    prints = [simhash.fingerprint(t, 5) for t in texts]
    near = {(j, i) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2 and similarity(texts[i], texts[j]) >= 0.8}
    assert seen["links"] == 1 and len(near) > 5 and seen["starred"] and not near & seen["starred"]
    assert all(simhash.of_hashes(shingle_dedup.all_shingles(t)) == p for t, p in zip(texts, prints))
