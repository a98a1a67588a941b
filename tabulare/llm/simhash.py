"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: A-Z lower-cased, words split at ASCII white space, shingles of
``width`` words (repeats included, joined by one space; fewer words: the
whole sequence). A fingerprint bit is set if more than half of the shingles'
XXH64 values (seed 42) have it. A text without words, NULL included, has
fingerprint zero and is linked like any other.

Links: distinct fingerprints at ``max_bits`` or fewer differing bits.
Documents with equal fingerprints collapse into one row first, so groups of
copies, however large, cost one row. A link has at most ``max_bits`` wrong
bits, so of ``max_bits + 1`` bit segments one is equal (level one), and of as
many sub-segments of the remaining bits one is equal again (level two); rows
meet only under an equal segment and sub-segment. Within such a bucket the
fingerprints are sorted by Gray rank and indexed by a tree: each node keeps
the bits that all fingerprints below it share (mask and pattern). The
self-join walks pairs of nodes from the root and drops a pair as soon as the
differences accumulated in the shared bits exceed the bound.

A bucket returns the edges of a spanning forest of its links, never the
pairs, so a dense bucket of m rows returns fewer than m edges. Components
follow by distributed label propagation over those edges. A bucket holds only
distinct fingerprints that agree in over half of their bits; its walk is
done in blocks of bounded size.

Repeated rows and rows without id keep their own output row in
``near_duplicates``; a NULL id is never the smallest id of a component that
has another. ``keep_first`` keeps one row of each component, chosen by
component and not by id: rows without id and different texts with one id are
documents like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulare.llm.common import discard, materialize

WIDTH = 3
MAX_BITS = 2
BITS = 64
FANOUT = 16
PAIRS_AT_ONCE = 1 << 18      # node pairs expanded at a time


# ---- fingerprints ---------------------------------------------------------

def _bits_over_half(hashes: np.ndarray) -> int:
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    set_in = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    h = xxhash.xxh64_intdigest
    return _bits_over_half(np.array([h(s, 42) for s in shingles], dtype=np.uint64))


def with_fingerprints(docs: DataFrame, width: int = WIDTH, text: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long."""
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts)).view(np.int64))
    return docs.withColumn(out, fp(F.col(text)))


# ---- links ----------------------------------------------------------------

def _cut(lo: int, hi: int, parts: int) -> list[tuple[int, int]]:
    edges = [lo + (hi - lo) * i // parts for i in range(parts + 1)]
    return list(zip(edges, edges[1:]))


def segment_masks(max_bits: int) -> list[int]:
    """One mask per (segment, sub-segment): two fingerprints within ``max_bits`` agree under one of them."""
    masks = []
    for lo, hi in _cut(0, BITS, max_bits + 1):
        seg = ((1 << (hi - lo)) - 1) << lo
        rest = [b for b in range(BITS) if not seg >> b & 1]
        masks += [seg | sum(1 << b for b in rest[a:z]) for a, z in _cut(0, len(rest), max_bits + 1)]
    return masks


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Position of each fingerprint in the reflected Gray code sequence."""
    r = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def _levels(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tree over Gray-sorted fingerprints, leaves first: (pattern, mask of shared bits) per node."""
    pattern, mask = fps, np.full(len(fps), np.iinfo(np.uint64).max, np.uint64)
    out = [(pattern, mask)]
    while len(pattern) > 1:
        starts = np.arange(0, len(pattern), FANOUT)
        ones = np.bitwise_and.reduceat(pattern & mask, starts)       # shared ones
        zeros = np.bitwise_and.reduceat(~pattern & mask, starts)     # shared zeros
        mask, pattern = ones | zeros, ones
        out.append((pattern, mask))
    return out


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def linked_within(fps: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Spanning forest (as index pairs into ``fps``) of the links among distinct fingerprints."""
    order = np.argsort(gray_rank(fps), kind="stable")
    levels = _levels(fps[order])
    parent = np.arange(len(fps))
    edges: list[tuple[int, int]] = []
    todo = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:                                        # depth first, in bounded chunks
        level, a, b = todo.pop()
        if len(a) > PAIRS_AT_ONCE:
            todo += [(level, a[i:i + PAIRS_AT_ONCE], b[i:i + PAIRS_AT_ONCE]) for i in range(0, len(a), PAIRS_AT_ONCE)]
            continue
        pattern, mask = levels[level]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= max_bits
        a, b = a[near], b[near]
        if level:
            below, n = level - 1, len(levels[level - 1][0])
            step = max(1, PAIRS_AT_ONCE // FANOUT ** 2)
            kids = np.arange(FANOUT)
            for i in range(0, len(a), step):
                x = (a[i:i + step, None] * FANOUT + kids)[:, :, None]
                y = (b[i:i + step, None] * FANOUT + kids)[:, None, :]
                x, y = np.broadcast_arrays(x, y)
                ok = (x < n) & (y < n) & (x <= y if below else x < y)
                todo.append((below, x[ok], y[ok]))
            continue
        # leaves: keep only links between parts that are not joined yet
        while len(a):
            roots = _roots(parent)
            apart = roots[a] != roots[b]
            a, b = a[apart], b[apart]
            if not len(a):
                break
            _, first = np.unique(roots[a], return_index=True)
            for i in first:
                x, y = _find(parent, a[i]), _find(parent, b[i])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    edges.append((int(order[a[i]]), int(order[b[i]])))
    return edges


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent[:] = up


def _bucket_edges(max_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []                    # the bucket that may go on in the next batch
        held_key = None

        def flush():
            fps = np.concatenate(held).view(np.uint64)
            if len(fps) < 2:
                return None
            pairs = linked_within(fps, max_bits)
            if not pairs:
                return None
            p = np.array(pairs)
            return pd.DataFrame({"a": fps[p[:, 0]].view(np.int64), "b": fps[p[:, 1]].view(np.int64)})

        for df in batches:
            if not len(df):
                continue
            seg, key, fp = (df[c].to_numpy() for c in ("seg", "key", "fp"))
            new = np.flatnonzero((seg[1:] != seg[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.r_[0, new], np.r_[new, len(fp)]
            if held_key != (seg[0], key[0]):
                if held and (out := flush()) is not None:
                    yield out
                held, held_key = [], (seg[0], key[0])
            held.append(fp[:ends[0]])
            if len(starts) > 1:
                if (out := flush()) is not None:
                    yield out
                for s, e in zip(starts[1:-1], ends[1:-1]):
                    if e - s > 1:
                        held = [fp[s:e]]
                        if (out := flush()) is not None:
                            yield out
                held, held_key = [fp[starts[-1]:]], (seg[-1], key[-1])
        if held and (out := flush()) is not None:
            yield out
    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``(a, b)`` that connect all fingerprints (distinct ``fp``) linked directly or through others."""
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in segment_masks(max_bits)]
    keys = F.array(*[F.struct(F.lit(i).alias("seg"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                     for i, m in enumerate(signed)])
    rows = fps.select("fp", F.inline(keys))
    buckets = rows.repartition("seg", "key").sortWithinPartitions("seg", "key")
    return buckets.mapInPandas(_bucket_edges(max_bits), "a long, b long")


# ---- components -----------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """``(v, root)`` for every vertex of ``edges (a, b)``: the smallest vertex reachable.

    Alternating large-star and small-star rounds over a shrinking edge list;
    each round is two grouped minima (combined map-side) and two joins whose
    skewed keys Spark may split. Every round is written, and deleted when the next is.
    """
    e = materialize(edges.where("a != b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "cc-edges")
    last = None
    while True:
        # large star: hang every larger neighbour (and itself) on the smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-low")
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        large = materialize(large, "cc-large")
        # small star: hang the smaller neighbours on the smallest of them
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        hung = large.join(least, "u")
        old, e = e, materialize(hung.select("v", "m").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc-edges")
        discard(old, low, large, least)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    return e.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v"), F.col("v").alias("root")).distinct())


def _rooted(groups: DataFrame, max_bits: int) -> DataFrame:
    """``groups`` (distinct ``fp, least``) with the ``root`` of each fingerprint's component."""
    comps = materialize(components(links(groups.select("fp"), max_bits)), "simhash-components")
    return groups.join(comps.withColumnRenamed("v", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least")


def near_duplicates(docs: DataFrame, width: int = WIDTH, max_bits: int = MAX_BITS) -> DataFrame:
    """Per document ``doc_id, fingerprint, component_id``."""
    keyed = materialize(with_fingerprints(docs.select("doc_id", "text"), width).select("doc_id", "fp"), "simhash-fp")
    groups = materialize(keyed.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-groups")
    rooted = _rooted(groups, max_bits)
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    class_of = materialize(materialize(rooted, "simhash-rooted").join(least, "root").select("fp", "component_id"), "simhash-classes")
    return keyed.join(class_of, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _identity(doc_id: Column, text: Column) -> Column:
    """What names a document, NULL ids last: its id and 128 bits of its text (which give its fingerprint)."""
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def keep_first(docs: DataFrame, width: int = WIDTH, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without near-duplicates: one row of each component stays, whatever its id.

    It is the document with the smallest id, one without id only if none has
    any; of different texts with that id the one with the smallest hash; of
    several rows with that id and text the smallest (columns compared in order).
    """
    keyed = materialize(with_fingerprints(docs.select("doc_id", "text"), width).select(
        "fp", _identity(F.col("doc_id"), F.col("text")).alias("who")), "simhash-fp")
    groups = materialize(keyed.groupBy("fp").agg(F.min("who").alias("least")), "simhash-groups")
    kept = _rooted(groups, max_bits).groupBy("root").agg(F.min("least").alias("who"))
    flat = lambda who: [F.coalesce(who["id"].cast("string"), F.lit("")).alias("k"), who["none"].alias("none"),
                        who["h1"].alias("h1"), who["h2"].alias("h2")]
    kept = materialize(kept.select(*flat(F.col("who"))), "simhash-kept")
    # the row travels as one struct, so its column names cannot clash with ours
    rows = docs.select(_identity(F.col("doc_id"), F.col("text")).alias("who"), F.struct(*docs.columns).alias("row"))
    keys = ["k", "none", "h1", "h2"]
    rows = rows.select(*flat(F.col("who")), "row").join(kept, keys, "left_semi")
    # partitioned by the keys already: the grouping adds no shuffle of the texts
    return rows.groupBy(*keys).agg(F.min("row").alias("row")).select("row.*")
