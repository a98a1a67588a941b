"""Document fingerprints: threshold-scaled shingle sketches, in DataFrame functions only.

A text's words (ASCII white space separates) make shingles of ``WIDTH``
words (fewer words: the whole sequence). The sketch keeps every shingle hash
below a fixed ``FRACTION`` of the hash range and, so that no text with words
is without one, the smallest hash. The sketch of a union is the union of the
sketches cut the same way, so sketches merge; they grow with their texts, so
the containment of a short text in a long one can be read off them.

``likeness`` is the share of the smaller sketch that the other one holds: 1
for equal texts and for a text contained in the other, 0 without any common
shingle. It is an estimate of the containment of the smaller text.

Scale: sketches are computed where the text is read. The edited text needs
the next document's text, so texts are shuffled once, into ranges of ids
(range bounds from a bounded quantile summary) in which ``lead`` finds the
next document; the first document of each range is also sent to the range
before. An id that spans several ranges (or the rows without id) is cut by a
hash of the text, so no range holds more than its share of rows; past
``MAX_RANGES`` ranges hold more rows, which the window spills.

Defined results for odd input: NULL text is empty, has the empty fingerprint
and is alike (1) only to another text without words; rows without id come
after the smallest id; rows with the same id follow each other by a hash of the
text, equal rows in any order; a single row is its own next document; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tabulare.llm.common import materialize

WIDTH = 5
FRACTION = 1 / 4
RANGE_ROWS = 500           # documents per range, until there are MAX_RANGES ranges
MAX_RANGES = 1 << 16
_SPACE = r"[\x20\x09-\x0D]+"


def sketch(text: Column, width: int = WIDTH, fraction: float = FRACTION) -> Column:
    """Sorted array of the retained shingle hashes."""
    hashes = F.transform(F.filter(F.split(text, _SPACE, -1), lambda w: w != ""), lambda w: F.xxhash64(w))
    return F.aggregate(F.array(hashes), F.array().cast("array<bigint>"), lambda _, h: _retained(h, width, fraction))


def _retained(words: Column, width: int, fraction: float) -> Column:
    shingles = F.when(F.size(words) == 0, F.array().cast("array<bigint>")).when(
        F.size(words) <= width, F.array(F.xxhash64(words))).otherwise(F.transform(
            F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)])))
    bound = int(-(1 << 63) + fraction * (1 << 64))
    return F.aggregate(F.array(shingles), F.array().cast("array<bigint>"), lambda _, s: F.sort_array(F.array_distinct(F.concat(
        F.filter(s, lambda h: h < bound), F.when(F.size(s) > 0, F.array(F.array_min(s))).otherwise(F.array().cast("array<bigint>"))))))


def fingerprint(retained: Column) -> Column:
    """Text form of a sketch: 16 lowercase hex digits per hash, ascending."""
    return F.lower(F.array_join(F.transform(retained, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the other holds; two empty ones are alike."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(
        (F.size(a) == F.size(b)).cast("double")).cast("double")


def _bounds(values: list[int]) -> list[tuple[int, int]]:
    """Range bounds (id, tie) from quantiles of ids: an id that spans m quantiles is cut into m + 1 parts by its ties."""
    out = []
    for value, times in sorted(Counter(values).items()):
        out += [(value, -(1 << 63) + (j << 64) // (times + 1)) for j in range(1, times + 1)] if times > 1 else [(value, -(1 << 63))]
    return out


def in_ranges(docs: DataFrame) -> tuple[DataFrame, W]:
    """``docs (doc_id, text)`` in ranges, and the window in which ``lead`` is the next row by descending id, cyclic.

    Rows marked ``guest`` only stand in as the row after the last of their range.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    # the hash is the tie-break of rows with one id; it stays when the text is gone
    tie = F.xxhash64("text")
    ids = docs.select(order.alias("o"))
    n = ids.count()
    ranges = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    bounds: list[tuple[int, int]] = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        bounds = _bounds(ids.agg(F.percentile_approx("o", shares, 20 * ranges)).first()[0])
    steps = [1 << i for i in reversed(range(max(1, (len(bounds) + 1).bit_length())))]
    padded = bounds + [((1 << 63) - 1, (1 << 63) - 1)] * (2 * steps[0] - len(bounds))
    held, ties = (F.split(F.lit(",".join(map(str, c))), ",").cast("array<bigint>") for c in zip(*padded))      # folded to constants
    reached = lambda at: (F.element_at(held, at) < order) | (F.element_at(held, at) == order) & (F.element_at(ties, at) <= tie)
    # the range of a row: how many bounds are at or below it, by binary search
    place = F.aggregate(F.lit(steps), F.lit(0), lambda at, s: F.when(reached(at + s), at + s).otherwise(at)) if bounds else F.lit(0)
    stats = materialize(docs.select(F.struct(order.alias("o"), tie.alias("t")).alias("key"), place.cast("int").alias("range")).groupBy("range")
                        .agg(F.max("key").alias("top")), "fp-ranges")                 # about MAX_RANGES rows at most
    asc = W.partitionBy(F.lit(1)).orderBy("range")
    heads = stats.select("range", "top", F.coalesce(F.lead("range").over(asc), F.min("range").over(
        W.partitionBy(F.lit(1)))).alias("goes_to"))
    rows = docs.withColumn("_o", order).withColumn("_t", tie).withColumn("_range", place.cast("int"))
    rows = rows.join(F.broadcast(heads.withColumnRenamed("range", "_range")), "_range")
    # each row in its own range, and the first of a range also as the guest after the last of the range above
    first = (F.col("_o") == F.col("top.o")) & (F.col("_t") == F.col("top.t"))
    places = F.array(F.struct(F.col("_range").alias("at"), F.lit(False).alias("guest")),
                     F.when(first, F.struct(F.col("goes_to").alias("at"), F.lit(True).alias("guest"))))
    rows = rows.withColumn("_place", F.explode(F.filter(places, lambda p: p.isNotNull())))
    rows = rows.select("doc_id", "text", F.col("_o").alias("o"), F.col("_t").alias("tie"), F.col("_place.at").alias("range"),
                       F.col("_place.guest").alias("guest"))
    return rows, W.partitionBy("range").orderBy("guest", F.desc("o"), F.desc("tie"))


def edit(text: Column, following: Column) -> Column:
    """``text`` with its last third (code points, rounded down) replaced by the start of ``following``."""
    cut = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - cut), F.substr(following, F.lit(1), cut))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: id, size, fingerprints of the text and the edited text, and their likenesses."""
    d, follows = in_ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    d = d.withColumn("edited", edit(F.col("text"), F.lead("text").over(follows)))
    d = d.select("doc_id", "range", "guest", "o", "tie", F.length("text").cast("long").alias("n_chars"),
                 F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text")).alias("kept"),
                 F.when(~F.col("guest"), sketch(F.col("edited"))).alias("edited_kept"))
    # same ranges, same order: the second window moves nothing
    d = d.withColumn("next_kept", F.lead("kept").over(follows)).where("NOT guest")
    return d.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("kept")).alias("fingerprint"),
                    fingerprint(F.col("edited_kept")).alias("edited_fingerprint"),
                    likeness(F.col("kept"), F.col("edited_kept")).alias("near_edited"),
                    likeness(F.col("kept"), F.col("next_kept")).alias("near_next"))
