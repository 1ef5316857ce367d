"""Pre-splitting of texts as the public tokenizer files do it, and bounded per-worker caches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import regex

#: What the tokenizers' patterns take as white space, and the patterns. Contractions begin with an
#: apostrophe, so it changes nothing that letters and digits are tried before them.
SPACE = r"\p{White_Space}"
BYTE_PATTERN = rf" ?\p{{L}}+| ?\p{{N}}+|'(?:s|t|re|ve|m|ll|d)| ?[^{SPACE}\p{{L}}\p{{N}}]+|{SPACE}+(?!\P{{White_Space}})|{SPACE}+"
WORD_PATTERN = rf"[\p{{L}}]+|[\p{{N}}]|'(?:s|t|re|ve|m|ll|d)|[^{SPACE}\p{{L}}\p{{N}}]+"
#: The same for ASCII texts, for the standard library's faster matcher.
ASCII_BYTE_PATTERN = r" ?[A-Za-z]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
ASCII_WORD_PATTERN = r"[A-Za-z]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^ \t-\rA-Za-z0-9]+"

#: What the two kinds of tokenizer files say of themselves where the functions here follow them.
BYTE_LEVEL = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}}
WORD_LEVEL = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
    ]},
}

#: Longer pre-tokens are encoded each time, so that the entries of a cache bound its size.
LONGEST_CACHED = 64


def expect(spec: dict, kind: dict) -> None:
    """Raise unless a tokenizer file splits and normalises texts as the functions here do."""
    without = lambda x: {k: without(v) for k, v in x.items() if k != "trim_offsets"} if isinstance(x, dict) else [without(v) for v in x] if isinstance(x, list) else x
    for part, wanted in kind.items():
        if without(spec.get(part)) != wanted:
            raise ValueError(f"the tokenizer file's {part} is not of the kind that this operator follows")
    if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in spec.get("added_tokens", [])):
        raise ValueError("special strings must be matched as they are")


def expect_file(path: str, kind: dict) -> None:
    with open(path, encoding="utf-8") as f:
        expect(json.load(f), kind)


def finder(ascii_pattern: str, pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern in a text."""
    plain, full = re.compile(ascii_pattern).findall, regex.compile(pattern).findall
    return lambda text: plain(text) if text.isascii() else full(text)


def byte_alphabet() -> dict[int, int]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


def special_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}


def splitter(specials: dict[str, int]) -> Callable[[str], list[str]]:
    """Cut a text at special strings; the odd items of the list are special strings."""
    if not specials:
        return lambda text: [text]
    found = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")")
    return found.split


class Rows(dict):
    """A dict that computes what it lacks, and keeps the first ``most`` of it."""

    def __init__(self, make: Callable, most: int = 1 << 21):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most:
            self[key] = value
        return value


class Cache(dict):
    """A dict that computes what it lacks and starts afresh when it is full."""

    def __init__(self, make: Callable, most: int = 500_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST_CACHED:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value
