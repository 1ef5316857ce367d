import random

import pytest

#: Columns of documents, and others whose names the operators use inside.
CLASHING = ["chunk", "fp", "rep", "key", "kept", "component_id", "salt", "id", "row_id", "t", "n", "lang_pred", "score", "recipe", "whole"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def sentence(rng: random.Random, n: int, words: str = "the of and to in is that for it as was with be by on not he his but at") -> str:
    return " ".join(rng.choice(words.split()) + rng.choice(["", "", "s", "ing", str(rng.randint(0, 99))]) for _ in range(n))


def hard_texts() -> list[str | None]:
    """Null, empty, blank, tiny, odd, long, copied, nearly copied and partly shared texts."""
    rng = random.Random(5)
    shared, long = sentence(rng, 80), sentence(rng, 30_000)
    base = sentence(rng, 200)
    near = base.replace(" the ", " The ", 1)
    return [
        None, "", "   ", "\t\n", "x", "one two", "12 34 !!", "é" * 300, "日本語のテキスト" * 40, "a" * 1000, "ab" * 400, "İΣß <|endoftext|>   end", long, long + " more", base, base, near, base.upper(),
        base.replace(" ", "  "), sentence(rng, 60) + " " + shared + " " + sentence(rng, 60), sentence(rng, 55) + "\n" + shared + "\n" + sentence(rng, 51), shared, sentence(rng, 49), sentence(rng, 50), "\0 nul", None, "",
    ]


@pytest.fixture(scope="session")
def docs(spark):
    """Hard texts with clashing columns, in a mixed order, one row repeated, with nulls in all columns but doc_id."""
    rows = [(i * 7 % 101, t, "en" if i % 3 else None, None if i % 4 == 0 else "s", None if t is None else len(t), *([None if i % 2 else "c"] * len(CLASHING))) for i, t in enumerate(hard_texts())]
    rows.append(rows[14])
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def collect(df) -> list:
    return [tuple(r) for r in df.collect()]


def of(docs) -> list[tuple[int, str | None]]:
    return sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if r["text"] is not None) + sorted((r["doc_id"], None) for r in docs.select("doc_id", "text").collect() if r["text"] is None)
