"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves every
pre-token that is a vocabulary entry as a whole. Tier two: a miss starts as
single bytes in a linked list; a heap hands out the adjacent pair with the
lowest rank, leftmost first, until no pair has a rank.

The vocabulary (ranks and hash tables, about 50,000 entries: bounded by the
rank file, not by the data) is read once on the driver and broadcast. Texts
are encoded where they are read: no shuffle. Each task works through Arrow
batches; a Python worker remembers the ids of pre-tokens and chunks (below)
of at most ``LONGEST`` characters, ``REMEMBERED`` bytes of each, so its
memory does not grow with the input, nor with the length of its words.

Texts are first cut into chunks at single spaces between two characters that
are not white space. No pre-token of the pattern spans such a place other
than by starting with that space, so a chunk with its space is split alone,
once, however often it occurs.

NULL and empty texts have no ids; an empty table gives no rows; repeated
rows each get their own result; columns named like an output are replaced in
it (outputs are ``doc_id`` and the ones asked for only).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

REMEMBERED = 96 << 20          # bytes of pre-tokens and of chunks that a worker remembers
LONGEST = 256                  # characters of a pre-token or chunk worth remembering
ENTRY = 240                    # bytes of an entry besides its characters and ids
ROWS_AT_ONCE = 128
BUCKET = 4                     # keys per first-level bucket of the perfect hash
_MIX = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary entries in order of their ranks (``base64 rank`` lines)."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def _slots(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Slot of each hash under displacement ``d``."""
    x = h ^ (d.astype(np.uint64) * np.uint64(_MIX))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x % np.uint64(n)


@dataclass
class PerfectHash:
    """Minimal perfect hash: ``n`` keys, ``n`` slots, one displacement per bucket.

    A bucket with one key stores its slot itself as ``-slot - 1``. ``rank``
    and ``check`` hold each slot's rank and 64-bit key hash; a looked-up key is
    compared with the entry's bytes as well, so a foreign key never resolves.
    """

    displacement: np.ndarray
    rank: np.ndarray
    check: np.ndarray

    @staticmethod
    def build(keys: list[bytes]) -> PerfectHash:
        hashes = hash_keys(keys)
        if len(np.unique(hashes)) != len(keys):
            raise ValueError("two vocabulary entries share a hash")
        n = len(keys)
        nb = max(1, n // BUCKET)
        bucket = (hashes % np.uint64(nb)).astype(np.int64)
        members: list[list[int]] = [[] for _ in range(nb)]
        for i, b in enumerate(bucket.tolist()):
            members[b].append(i)
        taken = np.zeros(n, bool)
        disp = np.zeros(nb, np.int64)
        rank = np.zeros(n, np.int64)
        for b in sorted(range(nb), key=lambda b: -len(members[b])):
            m = members[b]
            if len(m) < 2:
                break
            h, d0 = hashes[m], 1
            while True:                        # try displacements in runs of 64
                d = np.arange(d0, d0 + 64)
                s = _slots(h[None, :], d[:, None], n).astype(np.int64)
                free = ~taken[s].any(axis=1)
                hit = [j for j in np.flatnonzero(free) if len(set(s[j].tolist())) == len(m)]
                if hit:
                    disp[b], slots = d[hit[0]], s[hit[0]]
                    break
                d0 += 64
            taken[slots] = True
            rank[slots] = m
        spare = iter(np.flatnonzero(~taken).tolist())
        for b in range(nb):
            if len(members[b]) == 1:
                slot = next(spare)
                disp[b] = -slot - 1
                rank[slot] = members[b][0]
        return PerfectHash(disp, rank, hashes[rank])

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of the only entry that each hash can be, or -1."""
        d = self.displacement[(hashes % np.uint64(len(self.displacement))).astype(np.int64)]
        slot = np.where(d < 0, -d - 1, _slots(hashes, np.maximum(d, 0), len(self.rank)).astype(np.int64))
        return np.where(self.check[slot] == hashes, self.rank[slot], -1)


def hash_keys(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))


@dataclass
class Encoder:
    """Encodes texts by a vocabulary in rank order; a plain object that Spark broadcasts."""

    vocab: list[bytes]
    pattern: str
    perfect: PerfectHash = None
    ranks: dict[bytes, int] = field(default=None, repr=False)

    def __post_init__(self):
        self.ranks = {t: i for i, t in enumerate(self.vocab)}
        self.perfect = self.perfect or PerfectHash.build(self.vocab)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token that is no vocabulary entry: heap over linked bytes."""
        rank, n = self.ranks.get, len(piece)
        end = list(range(1, n + 1))            # entry i covers piece[i:end[i]]; 0 once it was merged away
        prev = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, stop = pop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue                       # one of the two was merged meanwhile
            end[i] = stop
            end[mid] = 0
            prev[stop] = i
            if stop < n and (r := rank(piece[i:end[stop]])) is not None:
                push(heap, (r, i, end[stop]))
            p = prev[i]
            if p >= 0 and (r := rank(piece[p:stop])) is not None:
                push(heap, (r, p, stop))
        out, i, ranks = [], 0, self.ranks
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def pieces(self, new: set[str], known: dict[str, bytes]) -> None:
        """Add the ids (little-endian, 4 bytes each) of new pre-tokens to ``known``."""
        new = list(new)
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        found = self.perfect.lookup(hash_keys(raw)).tolist()
        vocab, merge = self.vocab, self.merge
        for p, b, r in zip(new, raw, found):
            if r >= 0 and vocab[r] == b:
                known[p] = r.to_bytes(4, "little")
            else:
                known[p] = np.array(merge(b), "<u4").tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids.tolist()))


_SAFE = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"\s\s|^\s|\s\Z")


def chunks_of(text: str) -> list[str]:
    """Chunks of a text; joined by single spaces they are the text again."""
    return _SAFE.split(text) if _ODD.search(text) else text.split(" ")


class Memory:
    """Ids of pre-tokens and chunks met so far. Full, it keeps what came first (mostly what is
    frequent) and starts afresh once it has missed as much as it holds."""

    def __init__(self, enc: Encoder, most: int = REMEMBERED):
        self.enc, self.most = enc, most
        self.split = regex.compile(enc.pattern).findall
        self.known: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.sizes = [0, 0]
        self.missed = 0

    def _learn(self, texts: list[str], fresh: set[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        if new := {p for s in split for p in s}.difference(self.known):
            self.enc.pieces(new, self.known)
            fresh |= new
        get = self.known.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        cut = [chunks_of(t) for t in texts]
        new_pieces: set[str] = set()
        heads = self._learn([c[0] for c in cut], new_pieces)
        new_chunks = list({x for c in cut for x in c[1:]}.difference(self.chunks))
        self.chunks.update(zip(new_chunks, self._learn([" " + x for x in new_chunks], new_pieces)))
        get = self.chunks.__getitem__
        out = [h + b"".join(map(get, c[1:])) for h, c in zip(heads, cut)]
        for i, (held, new) in enumerate(((self.known, new_pieces), (self.chunks, new_chunks))):
            for x in new:
                cost = 4 * len(x) + len(held[x]) + ENTRY          # at most four bytes a character
                if len(x) > LONGEST or self.sizes[i] + cost > self.most:
                    del held[x]
                    self.missed += cost if len(x) <= LONGEST else 0
                else:
                    self.sizes[i] += cost
        if self.missed > self.most:
            self.known.clear()
            self.chunks.clear()
            self.sizes, self.missed = [0, 0], 0
        return out


_MEMORY: dict[str, Memory] = {}                # one per Python worker


def _memory(key: str, shared) -> Memory:
    if key not in _MEMORY:
        _MEMORY.clear()
        _MEMORY[key] = Memory(shared.value)
    return _MEMORY[key]


def tokenize(docs: DataFrame, path: str, pattern: str, ids: bool = True, decoded: bool = False,
             digests: bool = False) -> DataFrame:
    """``doc_id, n_tokens`` and, as asked for, ``ids``, ``decoded`` (bytes) and SHA-256 digests of both."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Encoder(read_ranks(path), pattern))
    schema = "doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", n_tokens long"
    schema += ", ids array<int>" * ids + ", decoded binary" * decoded + ", ids_sha256 string, decoded_sha256 string" * digests

    key = hashlib.sha256(repr((path, pattern, shared.value.vocab)).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc: Encoder = shared.value
        memory = _memory(key, shared)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                packed = memory.encode([t or "" for t in batch.column(1).to_pylist()])
                arrays = [batch.column(0), pa.array([len(p) // 4 for p in packed], pa.int64())]
                numbers = [np.frombuffer(p, "<u4") for p in packed]
                if ids:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in numbers])]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(
                        np.concatenate(numbers).astype(np.int32) if numbers else np.empty(0, np.int32))))
                if decoded or digests:
                    texts = [enc.decode(x) for x in numbers]
                    if decoded:
                        arrays.append(pa.array(texts, pa.binary()))
                    if digests:
                        arrays += [pa.array([hashlib.sha256(p).hexdigest() for p in x], pa.string()) for x in (packed, texts)]
                names = ["doc_id", "n_tokens"] + ["ids"] * ids + ["decoded"] * decoded + ["ids_sha256", "decoded_sha256"] * digests
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
