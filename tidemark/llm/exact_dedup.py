"""Exact duplicates by recipes of content-defined chunks, in DataFrame functions only.

A normalised text is cut where its own bytes say so: after five bytes whose hashes meet a condition that one place in 512 does
in any script, once a chunk has ``least`` bytes, and after ``most`` at the latest. The condition is one on a window, as of
a rolling hash: a byte with a 3-bit hash of 0, and two pairs of neighbours whose hashes add up to 0 modulo 8. As there are only 256 bytes, sets of
them say that in a regular expression over the text's bytes. So an inserted character moves the cuts near it alone. The distinct
chunks get identifiers: two 64-bit hashes under a seed, verified by comparing the chunks themselves,
that no two different chunks share one (else the next seed is tried). Texts are equal if their
ordered lists of identifiers are. So a chunk's characters are shuffled at most once for each task
that holds it, and a long text is compared and moved only as its short list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm import workspace

#: The characters taken as white space.
_SPACE = r"[\x20\x09-\x0D]"


def _set(multiplier: int, value: int) -> str:
    """All bytes whose 3-bit hash has a value, as a set of a regular expression over Latin-1."""
    return "[" + "".join(rf"\x{b:02x}" for b in range(256) if (b * multiplier >> 5) % 8 == value) + "]"


def _window(first: int, second: int) -> str:
    return "(?:" + "|".join(_set(first, v) + _set(second, -v % 8) for v in range(8)) + ")"


#: Where a chunk may end: at one place in 8**3 of bytes without order.
_CUT = _set(113, 0) + _window(181, 97) + _window(149, 211)


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty. Single spaces stay as they are and cost no match."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), rf"[\x09-\x0D]{_SPACE}*|\x20{_SPACE}+", " ")


def content_chunks(text: Column, least: int = 256, most: int = 4096) -> Column:
    """The chunks of a text, as strings of its UTF-8 bytes in Latin-1."""
    return F.regexp_extract_all(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), F.lit(rf"(?s).{{{least},{most}}}?{_CUT}|.{{1,{most}}}"), F.lit(0))


def _identifier(seed: int, chunk: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), chunk).alias("h"), F.xxhash64(chunk, F.lit(seed + 1)).alias("g"))


def chunk_identifiers(texts: DataFrame, text: str, seed: int = 0) -> DataFrame:
    """(id, chunk): the distinct chunks, with the identifier of each."""
    chunks = texts.select(F.explode(content_chunks(F.col(text))).alias("chunk"))
    return chunks.select(_identifier(seed, F.col("chunk")).alias("id"), "chunk").distinct()


def verified_seed(texts: DataFrame, text: str, tries: int = 8) -> int:
    """A seed under which no two different chunks of the table share an identifier."""
    for seed in range(0, 2 * tries, 2):
        if chunk_identifiers(texts, text, seed).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            return seed
    raise RuntimeError("no seed tells all chunks apart")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row, dropped ones too.

    Texts are equal when identical after each run of white space (0x20, 0x09-0x0D) becomes one
    space; null counts as empty, and all empty texts are equal. keep_id is the smallest doc_id of the group,
    null if no row of it has one. Rows that repeat a doc_id are one document: they count towards group_size
    and stay or go together. An empty table gives no rows; other columns are not read.
    """
    name = F.col(doc_id) if isinstance(docs.schema[doc_id].dataType, StructType) else F.col(doc_id).cast("long")
    rows = docs.select(name.alias("doc_id"), normalised(F.col(text)).alias("t"))
    seed = verified_seed(rows, "t")
    recipes = rows.select("doc_id", F.transform(content_chunks(F.col("t")), lambda c: _identifier(seed, c)).alias("recipe"), F.sha2("t", 256).alias("text_sha256"))
    recipes, _ = workspace.cut(recipes, "recipes")
    groups = recipes.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups, _ = workspace.cut(groups, "groups")
    found = recipes.join(groups, "recipe", "left").select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256")
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")
