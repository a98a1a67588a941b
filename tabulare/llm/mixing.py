"""Mixing sources to target weights.

Every document gets a hash-random key; within each source the documents are
range-sorted by that key, a distributed prefix sum of word counts runs along
the order, and the source's exact word budget is the cut. Rows of one key
(one id, or none) follow in order of a hash of the row (``tie``), equal rows
in order of a number of their own (``lot``), so the order is one of rows and
the cut falls into one row of a source. A source whose budget exceeds its
size is repeated: whole epochs first, the cut then falls in the last, partial
epoch.

Scale: text never moves. The cut is found level by level: the key it falls
in, the tie among the rows of that key, the lot among equal rows; the later
levels see only the rows of that one key. Each level is a two-level prefix
sum: range buckets of the uniform value (sized like the square root of the
input, so neither the rows of one bucket nor the buckets of one source pile
up in a task), sums per bucket, then a running sum inside each bucket. A hot
source, or a hot key or row in it, is spread over its many buckets. Only the table of sources (one row each) meets in a single
window, as the water level is a property of all sources together.

Defined results for odd input: NULL text has size 0; the NULL source is a
source of its own, sorted last; a source without words has target and taken
0; rows with the same id (or NULL ids) are documents of their own, and so are
equal rows, of which any may be the one that is cut; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tabulare.llm.common import materialize, md5_key, word_count

WEIGHTS = (5, 2, 1)      # by rank of the source, repeating
CAP = 3                  # a target stops at this many times the source's size
MIN_BUCKET = 500         # units a range bucket holds at least, on average
LEVELS = {"key": (0.0, 2.0 ** 60), "tie": (-2.0 ** 63, 2.0 ** 64), "lot": (-2.0 ** 63, 2.0 ** 64)}   # least value, range


def cyclic_weights(sources: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """``(source, weight)``: ``weights`` in turn, by code point order of the source, NULL last."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.select("source", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                 (rank % len(weights) + 1).cast("int")).alias("weight"))


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """Add ``target`` to ``(source, source_size, weight, ...)``.

    All sizes together are shared by weight; a target stops at ``cap`` times
    its size and the excess is shared again among the others. That fixed point
    is a water level ``lam``: ``target = min(cap * size, lam * weight)``. In
    order of ``cap * size / weight``, the level is the first one at which its
    own source is no longer capped.
    """
    by_ratio = W.orderBy("ratio", "source")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    s = sizes.withColumn("ratio", F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
    s = (s.withColumn("capped", F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)))
          .withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
          .withColumn("total", F.sum("source_size").over(everything))
          .withColumn("weights", F.sum("weight").over(everything))
          .withColumn("level", (F.col("total") - F.col("capped")).cast("double") / (F.col("weights") - F.col("gone"))))
    s = s.withColumn("lam", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    return (s.withColumn("target", F.least(F.lit(float(cap)) * F.col("source_size"), F.col("lam") * F.col("weight")))
             .drop("ratio", "capped", "gone", "total", "weights", "level", "lam"))


def _place(docs: DataFrame, seed: str) -> list[Column]:
    """``key, tie, lot``: a row's place in its source's order. ``lot`` is another one each time it is computed."""
    hashed = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind]
    return [md5_key(docs["doc_id"], seed).alias("key"), F.xxhash64(F.lit(seed), *hashed).alias("tie"),
            F.xxhash64(F.monotonically_increasing_id()).alias("lot")]          # one-to-one on longs


def _reached(rows: DataFrame, budgets: DataFrame, level: str) -> DataFrame:
    """Per source the value of ``level`` in which its ``rest`` runs out: ``source, cut_<level>, size, rest, rows`` of it.

    ``rows`` has ``source, size`` and the level, ``budgets`` ``source, rest, rows``; no row if nothing is left over.
    """
    least, width = LEVELS[level]
    # square-root decomposition: buckets of about sqrt(rows) units each
    per_bucket = F.greatest(F.lit(float(MIN_BUCKET)), F.sqrt(F.sum("rows").over(W.partitionBy(F.lit(1)))))
    lean = budgets.select(F.col("source").alias("s"), "rest", F.ceil(F.col("rows") / per_bucket).alias("buckets"))
    units = (rows.groupBy("source", level).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
                 .join(lean, F.col("source").eqNullSafe(F.col("s"))).drop("s")
                 .withColumn("bucket", F.floor((F.col(level) - F.lit(least)) / F.lit(width) * F.col("buckets")))
                 .select("source", "bucket", level, "size", "rows", "rest"))
    units = materialize(units, "mix-units")
    sums = units.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("rest").alias("budget"))
    offsets = sums.withColumn("until", F.sum("words").over(W.partitionBy("source").orderBy("bucket")))
    # the one bucket per source in which the budget runs out, then the running sum inside it
    cut_in = (offsets.where((F.col("until") - F.col("words") < F.col("budget")) & (F.col("until") >= F.col("budget")))
                     .select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.col("until") - F.col("words")).alias("offset")))
    inside = (units.join(cut_in, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
                   .withColumn("until", F.col("offset") + F.sum("size").over(W.partitionBy("source", "bucket").orderBy(level))))
    found = (inside.where((F.col("until") - F.col("size") < F.col("rest")) & (F.col("until") >= F.col("rest")))
                   .select("source", F.col(level).alias(f"cut_{level}"),
                           (F.col("rest") - F.col("until") + F.col("size")).alias("rest"), "rows"))
    return materialize(found, f"mix-{level}")


def source_cuts(sized: DataFrame, weigh=cyclic_weights, cap: int = CAP) -> DataFrame:
    """One row per source: ``source_size, target, epochs`` and where the partial epoch is cut.

    ``sized`` has ``source, key, tie, lot, size``. ``cut_key, cut_tie,
    cut_lot`` is the place of the row in which the budget of the partial epoch
    runs out, ``cut_words`` what is still taken of it (all NULL if the epochs
    are whole).
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    per_source = materialize(per_source, "mix-sources")
    weights = weigh(per_source.select("source"))
    s = per_source.join(weights, per_source["source"].eqNullSafe(weights["source"])).drop(weights["source"])
    s = targets(s, cap)
    budget = F.floor("target")
    s = (s.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)))
          .withColumn("rest", budget - F.col("epochs") * F.col("source_size")))
    s = materialize(s, "mix-targets")
    rows, budgets, cuts = sized, s, s.drop("rest", "rows")
    for level in LEVELS:
        budgets = _reached(rows, budgets, level)
        here = budgets.withColumnRenamed("source", "s")
        rows = rows.join(here.select("s", f"cut_{level}"), F.col("source").eqNullSafe(F.col("s")) & (F.col(level) == F.col(f"cut_{level}"))
                         ).drop("s", f"cut_{level}")
        cuts = cuts.join(here.drop("rows").withColumnRenamed("rest", "cut_words"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        if level != "lot":
            cuts = cuts.drop("cut_words")
    return cuts.select("source", "source_size", "target", F.col("epochs").cast("long").alias("epochs"),
                       *[f"cut_{level}" for level in LEVELS], "cut_words")


def extra_words(size: Column) -> Column:
    """Words that the partial epoch takes of a document at ``_key, _tie, _lot``."""
    here, cut = (F.struct(*[F.col(f"{x}_{level}").alias(level) for level in LEVELS]) for x in ("", "cut"))
    return (F.when(F.col("cut_key").isNull() | (here > cut), F.lit(0)).when(here < cut, size)
             .otherwise(F.col("cut_words"))).cast("long")


def _decide(keyed: DataFrame, sized: DataFrame, weigh, cap: int) -> DataFrame:
    """``keyed`` (``_source, _key, _tie, _lot, _size`` and anything else) with its source's cut."""
    cuts = materialize(source_cuts(sized, weigh, cap), "mix-cuts").withColumnRenamed("source", "_cut_source")
    return keyed.join(cuts, F.col("_source").eqNullSafe(F.col("_cut_source")), "left").drop("_cut_source")


def _sized(docs: DataFrame, seed: str, label: str, *columns: Column) -> tuple[DataFrame, DataFrame]:
    """``columns`` with what the mix needs as ``_source, _key, _tie, _lot, _size``, written once so that a row keeps
    its lot; and that alone as ``source, key, tie, lot, size``."""
    place = [F.col("source"), *_place(docs, seed), word_count(docs["text"]).alias("size")]
    names = ("source", *LEVELS, "size")
    keyed = materialize(docs.select(*columns, *[c.alias(f"_{n}") for c, n in zip(place, names)]), label)
    return keyed, keyed.select(*[F.col(f"_{n}").alias(n) for n in names])


def mix(docs: DataFrame, weigh=cyclic_weights, cap: int = CAP, seed: str = "") -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken``; ``weigh`` maps the sources to ``(source, weight)``."""
    keyed, sized = _sized(docs, seed, "mix-sized", F.col("doc_id"))
    d = _decide(keyed, sized, weigh, cap)
    return d.select("doc_id", F.col("_size").alias("size"), "source_size", "target",
                    (F.col("epochs") * F.col("_size") + extra_words(F.col("_size"))).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word (native; used on cut documents only)."""
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", -1)
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    return F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), (n + lead).cast("int")), ""), r"[\x20\x09-\x0D]++$", "")


def mix_documents(docs: DataFrame, weigh=cyclic_weights, cap: int = CAP, seed: str = "") -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, in the columns of ``docs``.

    A document of a repeated source comes once per epoch; the one at the cut
    comes, in the partial epoch, as its first ``cut_words`` words. The mix is
    measured in words, so documents without words are in no budget and stay once.
    """
    # one job writes the rows with their places; the text is read again, not shuffled. The row
    # travels as one struct, so its column names cannot clash with ours
    keyed, sized = _sized(docs, seed, "mix-rows", F.struct(*docs.columns).alias("row"))
    d = _decide(keyed, sized, weigh, cap).withColumn("extra", extra_words(F.col("_size")))
    whole = (F.col("epochs") + F.when((F.col("extra") == F.col("_size")) & (F.col("_size") > 0), 1).otherwise(0)).cast("int")
    copies = F.when(F.col("_size") == 0, F.array(F.lit(False))).otherwise(
        F.concat(F.array_repeat(F.lit(False), whole),
                 F.array_repeat(F.lit(True), F.when((F.col("extra") > 0) & (F.col("extra") < F.col("_size")), 1).otherwise(0))))
    d = d.withColumn("cut", F.explode(copies))
    text = F.when(F.col("cut"), first_words(F.col("row.text"), F.col("extra"))).otherwise(F.col("row.text"))
    out = {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("cut"), F.length(text)).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return d.select(*[out.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM src),
r AS (SELECT *, 3.0::DOUBLE * source_size / weight AS ratio FROM w),
lv AS (SELECT *, ((sum(source_size) OVER ()) - coalesce(sum(3 * source_size) OVER b, 0))::DOUBLE
                 / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER b, 0)) AS lam
       FROM r WINDOW b AS (ORDER BY ratio, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lam AS (SELECT lam FROM lv WHERE lam <= ratio ORDER BY ratio, lam LIMIT 1),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, lam.lam * weight) AS target FROM r, lam),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
c AS (SELECT s.*, e.source_size, e.target, e.epochs, CAST(floor(e.target) AS BIGINT) - e.epochs * e.source_size AS rest,
             sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k ROWS UNBOUNDED PRECEDING) - s.size AS before
      FROM sized s JOIN e ON s.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM c
"""
