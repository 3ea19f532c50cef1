"""Byte-level BPE by a pair occurrence index.

The distinct words of a step are laid out as linked lists of token ids. An index maps each adjacent pair that has a
merge rule to all its positions. The active ranks are applied in ascending order: one rank merges all its positions at
once, and the pairs that the merges make join the lists of their own ranks. As a pair with a merged token always ranks
after the merge that made the token, each rank is applied once.

The vocabulary file is a parameter; it is read on the executors, once a worker.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from foliant.llm.common import steps, tidy

#: The split pattern of this family of vocabularies (a fixed value of the format), with the common cases first: words,
#: then other marks; an apostrophe alone may begin a contraction. {L}, {N} and {S} are letters, numbers and white space.
SPLIT = r" ?[{L}]+| ?[^{S}{L}{N}'][^{S}{L}{N}]*|'(?:[stmd]|re|ve|ll)| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: For any text.
ANY = regex.compile(SPLIT.format(L=r"\p{L}", N=r"\p{N}", S=r"\s"))


def _class(pattern: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(256) if regex.match(pattern, chr(c)))


#: The same, faster, for texts of U+0000 to U+00FF.
LATIN = re.compile(SPLIT.format(L=_class(r"\p{L}"), N=_class(r"\p{N}"), S=_class(r"\s")))
#: Distinct words that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 300_000
#: UTF-8 bytes of text encoded at a time: the partition of the pair index.
BLOCK_BYTES = 2_500_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable ones stand for themselves, the rest follow from
    U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class PairIndexBPE:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.names = list(map(str, range(self.size)))
        self.id_of_byte = np.zeros(256, dtype=np.int64)
        for letter, b in letters.items():
            self.id_of_byte[b] = vocab[letter]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.forget()

    def forget(self) -> None:
        """Word k has the ids ``flat[starts[k]:starts[k + 1]]``."""
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(1, dtype=np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; -1 without a rule."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_of[at], -1)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' tokens one after another, and where each word starts among them (and the end)."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        total = int(sizes.sum())
        if not total:
            return np.zeros(0, dtype=np.int64), np.zeros(len(words) + 1, dtype=np.int64)
        token = self.id_of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        starts = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(sizes, out=starts[1:])
        word = np.repeat(np.arange(len(words)), sizes)
        after, before = np.arange(1, total + 1), np.arange(-1, total - 1)
        after[starts[1:][sizes > 0] - 1] = -1
        before[starts[:-1][sizes > 0]] = -1
        alive = np.ones(total, dtype=bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Adds the pairs that start at these positions to the index."""
            rank = self.ranks(token[at], token[after[at]])
            has = rank >= 0
            at, rank = at[has], rank[has]
            if not len(at):
                return
            if len(at) > 1:
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
                cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
                groups = zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts))
            else:
                groups = ((int(rank[0]), at),)
            for r, own in groups:
                if r in index:
                    index[r].append(own)
                else:
                    index[r] = [own]
                    heapq.heappush(active, r)

        enter(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            at = at[alive[at] & (token[at] == a)]
            follow = after[at]
            fits = (follow >= 0) & (token[follow] == b)
            at, follow = at[fits], follow[fits]
            if a == b and len(at) > 1:  # of a run, every second pair, from the left
                at.sort()
                follow = after[at]
                joined = np.concatenate(([False], follow[:-1] == at[1:]))
                run = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                every = (np.arange(len(at)) - run) % 2 == 0
                at, follow = at[every], follow[every]
            if not len(at):
                continue
            token[at] = self.made[r]
            alive[follow] = False
            beyond = after[follow]
            after[at] = beyond
            ahead = beyond >= 0
            before[beyond[ahead]] = at[ahead]
            back = before[at]
            fresh = np.concatenate((back[back >= 0], at[ahead]))
            if len(fresh):
                enter(fresh if len(at) == 1 else np.unique(fresh))
        counts = np.bincount(word[alive], minlength=len(words))
        ends = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(counts, out=ends[1:])
        return token[alive], ends

    def learn(self, words: list[str]) -> None:
        """Encodes words that are not remembered yet."""
        tokens, ends = self.merge_words([w.encode() for w in words])
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.starts = np.concatenate((self.starts, ends[1:] + len(self.flat)))
        self.flat = np.concatenate((self.flat, tokens.astype(np.int32)))

    def words(self, text: str) -> list[str]:
        """Whole ``text``; special tokens are words of their own."""
        if self.special_split and any(s in text for s in self.special):
            parts = self.special_split.split(text)
            return [w for part in parts for w in ([part] if part in self.special else self.split(part))]
        return self.split(text)

    @staticmethod
    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return ANY.findall(text)
        return LATIN.findall(text)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Special tokens' strings become their ids, as the vocabulary file lists them."""
        words = [self.words(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.forget()
        fresh = set(chain.from_iterable(words)).difference(self.known)
        special = [w for w in self.special if w in fresh]
        if fresh:
            self.learn(sorted(fresh.difference(special)))
        for w in special:
            self.known[w] = len(self.known)
            self.flat = np.append(self.flat, np.int32(self.special[w]))
            self.starts = np.append(self.starts, len(self.flat))
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(sizes.sum()))
        counts = self.starts[at + 1] - self.starts[at]
        ends = np.concatenate(([0], np.cumsum(counts)))
        ids = self.flat[np.repeat(self.starts[at] - ends[:-1], counts) + np.arange(ends[-1])]
        return np.split(ids, ends[np.cumsum(sizes)[:-1]]) if len(texts) else []

    def decode(self, ids: list[int]) -> str:
        """The text of token ids, special ones included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> PairIndexBPE:
    return PairIndexBPE(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (doc_id, text) with doc_id, ids array<int> and decoded string: what a training job reads. No shuffle.

    A null or empty text has no ids and decodes to an empty string. A very long text is encoded whole, as a step of its
    own. Of merges that tie at one place the leftmost is made, as the library does. Repeated rows are encoded each; an
    empty table gives an empty result. Other columns are not read, so clashing names do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in batches:
            for part in steps(batch, "text", BLOCK_BYTES):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = [x.tolist() for x in coder.encode_batch(texts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(map(coder.decode, ids), pa.string())], ["doc_id", "ids", "decoded"]
                )

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the
    text that the ids decode to, in UTF-8). Encodes as ``encode`` does, nulls, long texts and repeated rows included, and
    keeps digests in place of the ids; without ids both are digests of an empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in batches:
            for part in steps(batch, "text", BLOCK_BYTES):
                texts = [t or "" for t in part.column("text").to_pylist()]
                counts, names, decoded = [], [], []
                for found in coder.encode_batch(texts):
                    ids = found.tolist()
                    counts.append(len(ids))
                    names.append(hashlib.sha256(",".join(map(coder.names.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(names, pa.string()), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
