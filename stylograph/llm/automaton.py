"""BPE by a tokenization automaton.

The merges are compiled into a deterministic automaton over token sequences by successive merge gadgets. It starts as one state
with an arc for every base symbol. The gadget of a merge (a, b) makes a new state, a copy of the one that a's arcs lead to
but without an arc b; a's arcs now lead there, and every state that had an arc a gets an arc ab to where b led. In the
end a word has one path whose labels spell it: its BPE. All arcs of one token lead to one state, so a state is its parent,
the arc taken away and the merge at which it was made, and arcs are answered from these tables. Words are encoded by table-driven
transitions, longest label first, and decoded by emitting the labels of the arcs.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import texts

#: Fixed value: the splitting pattern of this family of word-end tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words, and pieces between white space, that a worker holds in each of two generations.
CACHE = 300_000
#: Longer pieces are encoded each time they come.
HELD = 64
#: Bytes of a word by which the labels that may come next are looked up.
LOOK = 5


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.labels = [""] * (max(vocab.values()) + 1)
        for word, i in vocab.items():
            self.labels[i] = word
        size = len(self.labels)
        #: Of a token: its two parts, the merge that makes it (-1: base symbol), whether that merge ever applies, its arcs' state.
        self.left, self.rank, self.live = [-1] * size, [-1] * size, [True] * size
        self.state = [0] * size
        #: Of a state: the state it copies, the arc it lacks, the merge at which it was made.
        self.parent, self.lacks, self.made = [0], [-1], [-1]
        for rank, (a, b) in enumerate(merges):
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.left[k], self.rank[k] = i, rank
            self.live[k] = self.live[i] and self.arc(self.state[i], j, rank)
            if self.live[k]:
                self.state[k] = self.state[j]
                self.parent.append(self.state[i])
                self.lacks.append(j)
                self.made.append(rank)
                self.state[i] = len(self.parent) - 1
        self._ancestry()
        self.known: dict[int, bool] = {}
        letter = byte_letters()
        back = {c: bytes([b]) for b, c in enumerate(letter)}
        self.inner, self.final = {}, {}
        for word, i in vocab.items():
            if self.live[i]:
                ends = word.endswith(suffix) and len(word) > len(suffix)
                (self.final if ends else self.inner)[b"".join(back[c] for c in (word[: -len(suffix)] if ends else word))] = i
        self.longest = max(map(len, [*self.inner, *self.final]))
        #: What the next LOOK bytes allow, filled as asked; beginnings of inner tokens longer than that.
        self.near: dict[bytes, tuple[tuple[tuple[int, int], ...], bool]] = {}
        self.longer = {b[:LOOK] for b in self.inner if len(b) > LOOK}

    def _ancestry(self) -> None:
        """Tables that answer arcs without walking from copy to copy: ancestors of a state 1, 2, 4 ... steps up, and where each arc is lost."""
        size = len(self.parent)
        depth, under = [0] * size, [1] * size
        for s in range(1, size):  # a state is made after the one it copies
            depth[s] = depth[self.parent[s]] + 1
        for s in range(size - 1, 0, -1):
            under[self.parent[s]] += under[s]
        #: Of a state: its number in a walk in which its copies, and theirs, are the numbers up to the last.
        self.first, free = [0] * size, [1] * size
        for s in range(1, size):
            p = self.parent[s]
            self.first[s] = free[p]
            free[p] += under[s]
            free[s] = self.first[s] + 1
        self.up = [self.parent]
        for _ in range(max(1, max(depth).bit_length()) - 1):
            last = self.up[-1]
            self.up.append([last[x] for x in last])
        self.up.reverse()
        #: Of a token: the states that lack it, by their numbers. None is a copy of another, as an arc can be lost but once.
        self.lost: dict[int, tuple[list[int], list[int]]] = {}
        for s in sorted(range(1, size), key=self.first.__getitem__):
            begins, ends = self.lost.setdefault(self.lacks[s], ([], []))
            begins.append(self.first[s])
            ends.append(self.first[s] + under[s])

    def arc(self, state: int, token: int, merges: int) -> bool:
        """Whether a state has an arc for a token after so many merges."""
        rank, made = self.rank, self.made
        while True:
            if rank[token] >= merges or not self.live[token]:
                return False
            if state == 0:
                return True
            if token == self.lacks[state]:
                return False
            if rank[token] < made[state]:  # it was copied with the parent, as that was then
                merges, state = made[state], self.parent[state]
            else:  # the merge added it if the state had an arc for its left part
                merges, token = rank[token], self.left[token]

    def step(self, before: int, token: int) -> bool:
        """Whether the state that arcs of `before` lead to has an arc for token: arc() by the tables, filled as asked."""
        key = before << 20 | token
        if (found := self.known.get(key)) is None:
            if len(self.known) > 2_000_000:
                self.known.clear()
            found = self.known[key] = self._has(self.state[before], token)
        return found

    def _has(self, state: int, token: int) -> bool:
        made, rank, number = self.made, self.rank, self.first
        if not self.live[token]:
            return False
        while state:
            if (lost := self.lost.get(token)) is not None:
                k = bisect_right(lost[0], number[state]) - 1
                if k >= 0 and number[state] < lost[1][k]:
                    return False
            if (limit := rank[token]) < made[state]:  # it was copied: go to the first copy's original that is as old as the token
                for table in self.up:
                    if made[above := table[state]] > limit:
                        state = above
                state = self.parent[state]
            if state:  # the merge added it if the state had an arc for its left part
                token = self.left[token]
        return True

    def choices(self, ahead: bytes) -> tuple[tuple[int, int], ...]:
        """(size, token) of the inner tokens that bytes begin with, longest first."""
        get = self.inner.get
        return tuple([(k, token) for k in range(min(len(ahead), self.longest), 0, -1) if (token := get(ahead[:k])) is not None])

    def ahead(self, rest: bytes) -> tuple[tuple[int, int], ...]:
        """choices(), looked up by the next bytes where no longer token begins so."""
        near = rest[:LOOK]
        found = self.near.get(near)
        if found is None:
            if len(self.near) > CACHE:
                self.near.clear()
            found = self.near[near] = (self.choices(near), len(near) == LOOK and near in self.longer)
        return self.choices(rest) if found[1] else found[0]

    def encode(self, word: bytes) -> list[int]:
        """The labels of the path that spells word: depth first, the longest that the state has an arc for first, dead ends kept out."""
        n, at, before, far = len(word), 0, -1, self.longest + 1
        known, final, ahead, step = self.known, self.final, self.ahead, self.step
        path: list[int] = []
        open_: list[tuple] = []
        dead: set[tuple[int, int]] = set()
        while True:
            rest = word[at : at + far]
            token = final.get(rest)  # a word's last label is a final one
            if token is not None and at + len(rest) == n and (before < 0 or (ok if (ok := known.get(before << 20 | token)) is not None else step(before, token))):
                path.append(token)
                return path
            left, some = n - at, iter(ahead(rest))
            while True:
                for size, token in some:
                    if size < left and (before < 0 or (ok if (ok := known.get(before << 20 | token)) is not None else step(before, token))) and (not dead or (at + size, token) not in dead):
                        break
                else:
                    if not open_:
                        raise ValueError(f"no path spells {word!r}")
                    dead.add((at, before))
                    at, before, left, some = open_.pop()
                    path.pop()
                    continue
                break
            open_.append((at, before, left, some))
            path.append(token)
            at, before = at + size, token


class Tokenizer:
    """A file of the tokenizers library: BPE with word ends over lower-cased NFC text, white space dropped, without decoder."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.split = regex.compile(PATTERN)
        labels = {**dict(enumerate(self.automaton.labels)), **{i: x for x, i in self.special.items()}}
        size = max(labels) + 1
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.spelt = [labels.get(i, "").encode("utf-8") for i in range(size)]
        #: Words, and what stands between white space, to ids (little-endian, joined): seen of late, and before.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def held(self, piece: str, make) -> bytes:
        found = self.young.get(piece) or self.old.get(piece) or make(piece)
        if len(piece) <= HELD:
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[piece] = found
        return found

    def word(self, word: str) -> bytes:
        packed = self.packed
        return b"".join([packed[i] for i in self.automaton.encode(word.encode("utf-8"))])

    def chunk(self, chunk: str) -> bytes:
        """The ids of what stands between white space: of one word if it is letters alone, as nearly all is."""
        if chunk.isascii() and chunk.isalpha():
            return self.word(chunk)
        found = self.split.findall(chunk)
        return self.word(chunk) if len(found) == 1 and found[0] == chunk else b"".join([self.held(w, self.word) for w in found])

    def plain(self, text: str) -> bytes:
        text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma
        text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split(), not to the pattern
            return b"".join([self.held(w, self.word) for w in self.split.findall(text)])
        get, held, make = self.young.get, self.held, self.chunk
        return b"".join([get(c) or held(c, make) for c in text.split()])

    def encode(self, text: str) -> bytes:
        """The ids, little-endian unsigned 32-bit."""
        if self.cut and any(x in text for x in self.special):
            return b"".join([self.packed[self.special[x]] if x in self.special else self.plain(x) for x in self.cut.split(text)])
        return self.plain(text)

    def decode(self, ids: bytes) -> bytes:
        """The labels of the arcs in UTF-8, joined by spaces."""
        spelt = self.spelt
        return b" ".join([spelt[i] for i in memoryview(ids).cast("I")]) if ids else b""


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def _encoded(path: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            docs, ids, decoded = [], [], []
            found = ((a, t.decode(a)) for a in map(t.encode, texts(batch.column("text"))))
            if digests:
                counts = []
                for a, b in found:
                    counts.append(len(a) // 4)
                    ids.append(hashlib.sha256(a).hexdigest())
                    decoded.append(hashlib.sha256(b).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                continue
            docs = batch.column("doc_id").to_pylist()
            for k, (a, b) in enumerate(found):  # a batch of long texts may be large: a row at a time
                yield pa.RecordBatch.from_arrays([pa.array([docs[k]], pa.int64()), pa.array([[int(x) for x in memoryview(a).cast("I")] if a else []], pa.list_(pa.int64())), pa.array([b.decode()], pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<bigint>, decoded. docs: doc_id bigint, text (null: empty), other columns are not read, whatever their names.

    An empty or white text has no id and decodes to the empty string. Repeated rows, and rows without doc_id, each get their
    row; an empty table gives none. Texts and words may have any length: what a worker holds is bounded, beside one batch.
    """
    return docs.select("doc_id", "text").mapInArrow(_encoded(path, False), "doc_id bigint, ids array<bigint>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """As encode(), with digests of ids and decoded text made where they are: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return docs.select("doc_id", "text").mapInArrow(_encoded(path, True), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
