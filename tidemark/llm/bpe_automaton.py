"""BPE encoding and decoding by a deterministic tokenization automaton.

The automaton's arcs carry tokens, and it accepts exactly the sequences that the merges produce. It
starts as one state with a loop for each byte. Each merge (u, v) -> w in turn applies a gadget:

* the state that u leads to is copied without the arc v, and all u arcs are led to the copy, so that
  u is no longer followed by v;
* every state with a u arc gains a w arc, to the state that v led to.

States therefore differ in the arcs that they lost, and a token leads to one state from wherever it
starts. While the gadgets run a state is kept as a difference: the arcs its own gadgets removed, with their times, and the
state that it copied, with the time. An arc w is there if none of the arcs it grew from (w, its left
part, that one's left part and so on) was removed while the next had not been born.

Then the transition table is compiled. Tokens are numbered along the tree of left parts, children by their birth, so
all arcs that grew from a lost one are a range of numbers, and a state's row is a short list of the ranges that it
lacks. The table is built once, on the driver, and broadcast; its size follows the vocabulary alone.

The automaton accepts one path for each byte string, so each prefix of a word has one state. A word is read byte by byte
from left to right: a second table (the tokens' labels as a deterministic matcher) says which tokens end at each byte, and the state
there is that of the one which the transition table allows after the state where it starts. Nothing is searched or taken
back. The arcs' labels spell the decoded text.
"""

from __future__ import annotations

import hashlib
import json
import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import presplit, workspace

_NEVER = 1 << 60


class Automaton:
    """The gadgets, one for each merge; compile() gives the transition table."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]):
        """labels: the bytes of each token; merges: (u, v, w) in order of their priority."""
        self.labels, self.token = labels, {}
        self.left: list[int] = [-1] * len(labels)
        self.born: list[int] = [-1] * len(labels)
        #: Of each state, named by a token that leads to it: what its gadgets removed, and the state it copied with the time.
        self.lost: list[dict[int, int]] = [{} for _ in labels]
        self.copied: list[tuple[int, int] | None] = [None] * len(labels)
        for i, b in enumerate(labels):
            if len(b) == 1:
                self.token[b] = i
        for time, (u, v, w) in enumerate(merges):
            self.gadget(time, u, v, w)

    def gadget(self, time: int, u: int, v: int, w: int) -> None:
        if self.token.get(self.labels[u]) != u or self.token.get(self.labels[v]) != v or not self.has_arc(u, v):
            return  # u is never followed by v, so the merge never applies
        if self.labels[w] not in self.token:
            self.token[self.labels[w]] = w
            self.left[w], self.born[w] = u, time
            self.copied[w] = (v, time)
        self.lost[u].setdefault(v, time)

    def has_arc(self, a: int, t: int) -> bool:
        """Whether the state that a leads to has an arc t."""
        until = _NEVER
        while True:
            lost = self.lost[a]
            if lost:
                arc, end = t, _NEVER
                while arc >= 0:
                    time = lost.get(arc)
                    if time is not None and time < until and time <= end:
                        return False
                    arc, end = self.left[arc], self.born[arc]
            if self.copied[a] is None:
                return True
            a, until = self.copied[a]

    def compile(self) -> Table:
        children: dict[int, list[int]] = {}
        for t in sorted(self.token.values(), key=lambda t: (self.born[t], t)):
            children.setdefault(self.left[t], []).append(t)
        number, past, todo, count = np.full(len(self.labels), -1, np.int32), [0] * len(self.labels), [(t, False) for t in reversed(children.get(-1, []))], 0
        while todo:
            t, done = todo.pop()
            if done:
                past[t] = count
                continue
            number[t] = count
            count += 1
            todo.append((t, True))
            todo += [(c, False) for c in reversed(children.get(t, []))]

        def gone(t: int, time: int) -> list[tuple[int, int]]:
            """The arc t, and all that grew from it no earlier than it was lost."""
            grown = children.get(t, [])
            k = bisect_left(grown, time, key=self.born.__getitem__)
            return [(int(number[t]), int(number[t]) + 1)] + ([(int(number[grown[k]]), past[t])] if k < len(grown) else [])

        row, edges = np.zeros(len(self.labels) + 1, np.int64), []
        for state in range(len(self.labels)):
            lacks, a, until = [], state, _NEVER
            while number[state] >= 0:
                for t, time in self.lost[a].items():
                    if time < until:
                        lacks += gone(t, time)
                if self.copied[a] is None:
                    break
                a, until = self.copied[a]
            end = -1
            for lo, hi in sorted(lacks):
                if lo > end:
                    edges += [lo, hi]
                elif hi > edges[-1]:
                    edges[-1] = hi
                end = edges[-1]
            row[state + 1] = len(edges)
        return Table(self.labels, self.token, number, row, np.array(edges, np.int32))


class Table:
    """The transition table: which tokens may follow which, and what their arcs are labelled."""

    def __init__(self, labels: list[bytes], token: dict[bytes, int], number: np.ndarray, row: np.ndarray, edges: np.ndarray, most: int = 500_000):
        """number: each token's place in the rows; edges of a state: where the ranges of arcs that it lacks begin and end, in order."""
        self.labels, self.token, self.number, self.row, self.edges, self.most = labels, token, number, row, edges, most
        self.rest()

    def rest(self) -> None:
        self.match()
        self.rows = presplit.Rows(self.row_of)
        self.after = (self.number + 1).tolist()
        self.cache = presplit.Cache(self.path, self.most)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("next", "fail", "here", "found", "rows", "after", "cache")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.rest()

    def match(self) -> None:
        """The matcher: nodes are beginnings of tokens; next goes on from one by a byte, fail to the longest end of it that is a beginning too."""
        self.next, self.here, last = {}, [-1], [0]
        for label, t in self.token.items():
            node = 0
            for b in label:
                key = node << 8 | b
                child = self.next.get(key)
                if child is None:
                    child = self.next[key] = len(self.here)
                    self.here.append(-1)
                    last.append(key)
                node = child
            self.here[node] = t
        self.fail = [0] * len(self.here)
        depth = [0] * len(self.here)
        for node in range(1, len(last)):
            depth[node] = depth[last[node] >> 8] + 1
        steps = dict(self.next)
        for node in sorted(range(1, len(last)), key=depth.__getitem__):
            back, b = self.fail[last[node] >> 8], last[node] & 255
            if last[node] >> 8:
                while back and back << 8 | b not in steps:
                    back = self.fail[back]
                self.fail[node] = steps.get(back << 8 | b, 0)
        self.found = presplit.Rows(self.tokens_at)
        self.next = presplit.Rows(self.go)
        self.next.update(steps)

    def go(self, key: int) -> int:
        """Where the matcher goes from a node (the upper bits) by a byte that doesn't go on from it."""
        node, b = key >> 8, key & 255
        return self.next[self.fail[node] << 8 | b] if node else 0

    def tokens_at(self, node: int) -> list[tuple[int, int, int]]:
        """(length, token, place in the rows) of the tokens that end at a node, the longest first."""
        out = []
        while node:
            t = self.here[node]
            if t >= 0:
                out.append((len(self.labels[t]), t, self.after[t]))
            node = self.fail[node]
        return out

    def row_of(self, state: int) -> list[int]:
        return self.edges[self.row[state] : self.row[state + 1]].tolist()

    def step(self, state: int, t: int) -> bool:
        """Whether the table has an arc t from a state, which is named by a token that leads to it."""
        return not bisect_left(self.rows[state], self.after[t]) & 1

    def path(self, word: bytes) -> bytes:
        """The tokens' ids, as little-endian 32-bit integers, of the one accepted path that spells the word."""
        whole = self.token.get(word)
        if whole is not None:  # every arc starts at the first state
            return whole.to_bytes(4, "little")
        step, found, rows, states, node = self.next, self.found, self.rows, [-1] * (len(word) + 1), 0
        for end, b in enumerate(word, 1):
            node = step[node << 8 | b]
            for n, t, place in found[node]:
                if n == end or not bisect_left(rows[states[end - n]], place) & 1:  # as step()
                    states[end] = t
                    break
            else:
                raise ValueError(f"no path spells {word[:40]!r}")
        ids, at = [], len(word)
        while at:
            ids.append(states[at])
            at -= len(self.labels[states[at]])
        return struct.pack(f"<{len(ids)}I", *reversed(ids))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids.tolist()))


class Codec:
    """Encoder and decoder for a byte-level tokenizer file: special strings, pre-splitting, table."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        presplit.expect(spec, presplit.BYTE_LEVEL)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        back = {chr(c): b for b, c in presplit.byte_alphabet().items()}
        self.specials = presplit.special_tokens(path)
        labels = [b""] * (1 + max([*vocab.values(), *self.specials.values()]))
        for s, i in vocab.items():
            labels[i] = bytes(back[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.table = Automaton(labels, [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs]).compile()
        for s, i in self.specials.items():
            labels[i] = s.encode("utf-8")
        self.ready()

    def ready(self) -> None:
        self.split, self.words = presplit.splitter(self.specials), presplit.finder(presplit.ASCII_BYTE_PATTERN, presplit.BYTE_PATTERN)

    def __getstate__(self) -> dict:
        return {"specials": self.specials, "table": self.table}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.ready()

    def encode(self, text: str) -> np.ndarray:
        parts, out, paths = self.split(text), [], self.table.cache
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.specials[part].to_bytes(4, "little"))
            else:
                out += [paths[w.encode("utf-8")] for w in self.words(part)]
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.table.decode(ids).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row; with keep also ids and decoded.

    Null counts as empty: no tokens, an empty decoded text. Repeated rows are encoded each, rows without doc_id too; an
    empty table gives no rows; other columns are not read. The table is compiled once, on the driver; the tokenizer
    file must be of the byte-level kind whose patterns presplit has, else this raises.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Codec(tokenizer_path))
    schema = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            ids = [own.encode(t or "") for t in b["t"].to_pylist()]
            decoded = [own.decode(x) for x in ids]
            out = [b["i"], [len(x) for x in ids], [hashlib.sha256(x.tobytes()).hexdigest() for x in ids], [hashlib.sha256(s.encode("utf-8")).hexdigest() for s in decoded]]
            out += [[x.astype(np.int32) for x in ids], decoded] if keep else []
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, kind) for x, (_, kind) in zip(out, schema)], schema=pa.schema(schema))

    workspace.small_batches(docs.sparkSession)
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    return docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(run, ddl)
