"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Spark counts the words of all documents; the most frequent ones, with their ids by the merge rules,
are compiled into a minimal acyclic automaton whose states share suffixes. Every arc carries how
many words lie before it, so the sum along a word's path is the word's number, and a table maps
numbers to ids. The compiled bytes (a few MB, bounded by LEXICON_WORDS) are broadcast; each Python
worker maps them into memory from a file. Words that are not in it are merged exactly.

Ids equal those of the tokenizers library for the same vocabulary file, its special token in a text
included. Defined results: a null or empty text has no ids and decodes to an empty text; repeated
rows get the same result; other columns are ignored by ``digest``.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinkweave.llm.common import cut, most_frequent

VOCABULARY = "byte_bpe_50k.json"
LEXICON_WORDS = 65_536
#: Words that a worker remembers with their ids, beside the lexicon.
CACHE_WORDS = 300_000
#: From this many bytes on, merges use a heap, so that one endless word stays n log n.
LONG_WORD = 48
_NEVER = 1 << 40
#: The tokenizer's pattern for texts of ASCII and Latin-1 letters, where these classes are the same.
_BEYOND_LATIN = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ]")
_LATIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9À-ÖØ-öø-ÿ]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves,
    the others are moved, in order, to 256 and beyond."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


class Merges:
    """Exact byte-pair merges of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = _byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letter[c] for c in token)

        ids = {token: k for token, k in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {k: raw(t) for t, k in ids.items() if t not in self.special} | {k: t.encode() for t, k in self.special.items()}
        self.start = [0] * 256
        for c, b in letter.items():
            self.start[b] = ids[c]
        #: (left id, right id) as one number -> rank, and rank -> merged id
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[ids[a] << 32 | ids[b]] = rank
            self.made.append(ids[a + b])
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of text, and whether they are a special token."""
        if self.at_special is None or not any(s in text for s in self.special):
            yield text, False
            return
        for k, part in enumerate(self.at_special.split(text)):
            if part:
                yield part, k % 2 == 1

    def merge(self, word: str) -> list[int]:
        ids = [self.start[b] for b in word.encode("utf-8", "surrogatepass")]
        if len(ids) >= LONG_WORD:
            return self._merge_long(ids)
        rank, made = self.rank.get, self.made
        ranks = [rank(a << 32 | b, _NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            k = ranks.index(best)  # lowest rank first, then leftmost
            ids[k] = new = made[best]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank(ids[k - 1] << 32 | new, _NEVER)
            if k < len(ranks):
                ranks[k] = rank(new << 32 | ids[k + 1], _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same, with a heap of pairs over a linked list: lowest rank first, then leftmost."""
        rank, made, n = self.rank.get, self.made, len(ids)
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(x, k, ids[k], ids[k + 1]) for k in range(n - 1) if (x := rank(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            best, k, a, b = heapq.heappop(heap)
            right = nxt[k]
            if ids[k] != a or right < 0 or ids[right] != b:
                continue
            ids[k], ids[right] = made[best], -1
            nxt[k] = nxt[right]
            if nxt[k] >= 0:
                prv[nxt[k]] = k
            for left in (prv[k], k):
                if left >= 0 and nxt[left] >= 0 and (x := rank(ids[left] << 32 | ids[nxt[left]])) is not None:
                    heapq.heappush(heap, (x, left, ids[left], ids[nxt[left]]))
        return [x for x in ids if x >= 0]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """Words and their ids as the bytes of a minimal acyclic transducer.

    Layout: counts; per state its first arc; per state whether a word ends there; per arc its
    target and the words before it; per word its first id; ids; arc labels (one byte each)."""
    words = sorted((w.encode("utf-8"), ids) for w, ids in entries.items() if w)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # the last word's open nodes: [final, [(label, frozen state)]]
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            state = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], state))

    for word, _ in words:
        common = next((k for k, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        close(common)
        path.extend([False, []] for _ in range(len(word) - common))
        path[-1][0] = True
        last = word
    close(0)
    root = freeze(path[0])
    total = [0] * len(states)
    for k, (final, arcs) in enumerate(states):  # targets are frozen before their sources
        total[k] = final + sum(total[t] for _, t in arcs)
    first, target, before, labels = [], [], [], bytearray()
    for final, arcs in states:
        first.append(len(target))
        seen = int(final)
        for label, t in arcs:
            labels.append(label)
            target.append(t)
            before.append(seen)
            seen += total[t]
    first.append(len(target))
    starts, flat = [0], []
    for _, ids in words:
        flat.extend(ids)
        starts.append(len(flat))
    finals = [int(f) for f, _ in states]
    head = struct.pack("<5I", len(states), len(target), len(words), len(flat), root)
    return head + b"".join(struct.pack(f"<{len(x)}I", *x) for x in (first, finals, target, before, starts, flat)) + bytes(labels)


class Lexicon:
    """A compiled lexicon, mapped from a file of its own."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:  # the mapping outlives the name
            f.write(data)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n_states, n_arcs, n_words, n_ids, self.root = struct.unpack_from("<5I", self._map)
        at = 20
        view = memoryview(self._map)

        def part(n: int) -> memoryview:
            nonlocal at
            at += 4 * n
            return view[at - 4 * n : at].cast("I")

        self.first, self.final, self.target, self.before, self.starts, self.ids = (part(n) for n in (n_states + 1, n_states, n_arcs, n_arcs, n_words + 1, n_ids))
        self.labels = at

    def get(self, word: str) -> list[int] | None:
        state, number, first, base, find = self.root, 0, self.first, self.labels, self._map.find
        for b in word.encode("utf-8", "surrogatepass"):
            arc = find(bytes((b,)), base + first[state], base + first[state + 1]) - base
            if arc < 0:
                return None
            number += self.before[arc]
            state = self.target[arc]
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist() if self.final[state] else None


class Encoder:
    """Encodes texts to packed ids (little-endian, 4 bytes each)."""

    def __init__(self, merges: Merges, lexicon: Lexicon | None):
        self.merges, self.lexicon = merges, lexicon
        self.cache: dict[str, bytes] = {}

    def _packed(self, word: str) -> bytes:
        ids = self.lexicon.get(word) if self.lexicon else None
        if ids is None:
            ids = self.merges.merge(word)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) < LONG_WORD:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        out, get, packed = [], self.cache.get, self._packed
        for piece, special in self.merges.pieces(text or ""):
            if special:
                out.append(struct.pack("<I", self.merges.special[piece]))
            else:
                split = self.merges.split if _BEYOND_LATIN.search(piece) else _LATIN_SPLIT
                out += [get(w) or packed(w) for w in split.findall(piece)]
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        return self.merges.decode(struct.unpack(f"<{len(packed) // 4}I", packed))


_ready: dict[tuple, Encoder] = {}


def encoder(vocabulary: str, data: bytes | None) -> Encoder:
    """This process's encoder, made once for each vocabulary and lexicon."""
    key = (vocabulary, data and hashlib.md5(data).digest())
    if key not in _ready:
        _ready.clear()
        _ready[key] = Encoder(Merges(vocabulary), Lexicon(data) if data else None)
    return _ready[key]


def frequent_words(docs: DataFrame, n: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all documents, n at most, each with the space before it, as the
    tokenizer's pattern cuts them. Counted on the map side first."""
    pieces = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r" ?\p{L}+"), F.lit(0))).alias("w"))
    counted = cut(pieces.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and length(w) <= 40"), "bpe-words")
    return [r["w"] for r in most_frequent(counted, n).select("w").orderBy("w").collect()]


def build(docs: DataFrame, vocabulary: str, n_words: int = LEXICON_WORDS) -> bytes | None:
    merges = Merges(vocabulary)
    words = frequent_words(docs, n_words)
    return compile_lexicon({w: merges.merge(w) for w in words}) if words else None


def encode(docs: DataFrame, vocabulary: str | None = None, n_words: int = LEXICON_WORDS) -> DataFrame:
    """Every document's columns and ``ids`` (array of int)."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    shared = docs.sparkSession.sparkContext.broadcast(build(docs, path, n_words))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path, shared.value)
        for texts in batches:
            yield pd.Series([list(struct.unpack(f"<{len(p) // 4}I", p)) for p in map(own.encode, texts)])

    return docs.withColumn("ids", F.pandas_udf(run, "array<int>")("text"))


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``; ids outside the vocabulary fail."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path, None)
        for ids in batches:
            yield pd.Series([own.merges.decode([] if x is None else x) for x in ids], dtype="object")

    return encoded.withColumn("decoded", F.pandas_udf(run, "string")("ids"))


def digest(docs: DataFrame, vocabulary: str | None = None, n_words: int = LEXICON_WORDS) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, by encoding and decoding again."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    shared = docs.sparkSession.sparkContext.broadcast(build(docs, path, n_words))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(path, shared.value)
        for texts in batches:
            rows = []
            for text in texts:
                packed = own.encode(text)
                again = own.decode(packed).encode("utf-8", "surrogatepass")
                rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(again).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"], dtype=object)

    made = F.pandas_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string")("text")
    return docs.select("doc_id", made.alias("r")).select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")
