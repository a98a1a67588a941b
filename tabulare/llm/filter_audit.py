"""Interaction audit of filters: what each removes in every order, and its Shapley share.

Filters are applied one after another, so what a filter removes depends on
those before it. All of that follows from the removals of the 32 coalitions
(sets) of the five filters: r(S) is the number of documents that fail at least
one filter of S. A step's removals are r(prefix with the filter) - r(prefix);
the same for labelled documents; what only one filter fails is r(all) - r(all
others).

The Shapley values are the exact solution of the constrained least squares
problem: the additive model closest to r over all proper coalitions, weighted
by the Shapley kernel, under efficiency (the values sum to r(all)). The normal
equations with their Lagrange multiplier are solved once in rationals, for
every unit r; the solution is linear in r, and times 120 it is whole.

Filters (words are ASCII-white-space separated): A fewer than 200 words; B
fewer than half of the words distinct; C more than 2 % of the characters in
A-Z; D any of ``#$%&*|``; E equal to the text of a smaller id.

Scale: flags A to D and a SHA-256 are computed where the text is read, and a
row of a few dozen bytes leaves the task. Equal rows are counted before the
shuffle; the smallest id of a text is a partial minimum, and it is looked up
by text and id together, so a text that a third of all rows share meets in no
task. Counts end as at most 32 cells per part.

Defined results for odd input: NULL text is empty and NULL part the empty
string; a document without id is neither smaller nor larger than another: it
passes E and makes no other fail; rows with one id and one text do not fail E
for each other and count as often as they occur; of several labels of an id
any 1 counts; an empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulare.llm.common import materialize

FILTERS = "ABCDE"
MIN_WORDS = 200
_BLANKS = "\t\n\x0b\x0c\r"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that read one text (not NULL)."""
    words = F.filter(F.split(F.translate(text, _BLANKS, " " * len(_BLANKS)), " ", -1), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    count, distinct, size, capitals = (x.cast("long") for x in (F.size(words), F.size(F.array_distinct(words)), F.length(text), capitals))
    return {"A": count < MIN_WORDS, "B": 100 * distinct < 50 * count, "C": 100 * capitals > 2 * size, "D": text.rlike("[#$%&*|]")}


def failing(docs: DataFrame, part: str = "source") -> DataFrame:
    """``doc_id, part, mask, copies``: the filters each document fails, as bits in the order of ``FILTERS``."""
    d = docs.select(F.col("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    bits = [F.when(c, 1 << FILTERS.index(f)).otherwise(0) for f, c in text_failures(F.col("text")).items()]
    d = d.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("same"), sum(bits[1:], bits[0]).alias("mask"))
    d = materialize(d.groupBy("doc_id", "part", "same", "mask").agg(F.count(F.lit(1)).alias("copies")), "audit-rows")
    first = d.groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    later = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return d.join(first, ["same", "doc_id"], "left").select(
        "doc_id", "part", (F.col("mask") + F.when(later, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"), "copies")


def shapley_coefficients(n: int) -> list[list[int]]:
    """``n!`` times the Shapley value of each player as whole coefficients of r(S), S = 0 .. 2^n - 1."""
    full = (1 << n) - 1
    # the Shapley kernel of every proper, non-empty coalition
    weight = {s: Fraction(n - 1, comb(n, k) * k * (n - k)) for s in range(1, full) for k in [s.bit_count()]}
    # normal equations: sum of weight over coalitions that hold i and j; the last row and column are the constraint
    rows = [[sum(w for s, w in weight.items() if s >> i & s >> j & 1) for j in range(n)] + [Fraction(1)] for i in range(n)]
    rows.append([Fraction(1)] * n + [Fraction(0)])
    right = [[weight.get(s, Fraction(0)) * (s >> i & 1) for s in range(full + 1)] for i in range(n)]
    right.append([Fraction(int(s == full)) for s in range(full + 1)])
    for i in range(n + 1):                       # elimination, exact
        p = next(r for r in range(i, n + 1) if rows[r][i])
        rows[i], rows[p], right[i], right[p] = rows[p], rows[i], right[p], right[i]
        scale = rows[i][i]
        rows[i], right[i] = [x / scale for x in rows[i]], [x / scale for x in right[i]]
        for r in range(n + 1):
            if r != i and rows[r][i]:
                by = rows[r][i]
                rows[r] = [x - by * y for x, y in zip(rows[r], rows[i])]
                right[r] = [x - by * y for x, y in zip(right[r], right[i])]
    whole = [[factorial(n) * x for x in right[i]] for i in range(n)]
    assert all(x.denominator == 1 for row in whole for x in row)
    return [[int(x) for x in row] for row in whole]


def interactions(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Counts of every step of every order, per part, from ``part, mask, rows, good, toxic``."""
    n = len(filters)
    full = (1 << n) - 1
    removed = lambda c: F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(c)).otherwise(0)) for s in range(full + 1)])
    by_part = cells.groupBy("part").agg(F.sum("rows").alias("all"), *[removed(c).alias(f"r_{c}") for c in ("rows", "good", "toxic")])
    values = [sum((c * F.get("r_rows", F.lit(s)) for s, c in enumerate(row) if c), F.lit(0).cast("long")) for row in shapley_coefficients(n)]
    by_part = by_part.withColumn("values", F.array(*values))
    orders = F.lit(["".join(p) for p in permutations(filters)])
    steps = by_part.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    place = {f: F.instr(F.col("filter_order"), f) for f in filters}
    mask = lambda holds: sum((F.when(holds(place[f]), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    steps = steps.withColumn("before", mask(lambda p: p < F.col("step"))).withColumn("own", mask(lambda p: p == F.col("step")))
    at = lambda c, s: F.get(F.col(f"r_{c}"), s)
    after = F.col("before") + F.col("own")
    gone = lambda c: at(c, after) - at(c, F.col("before"))
    who = F.instr(F.lit(filters), F.substr("filter_order", F.col("step"), F.lit(1))) - 1
    return steps.select("part", "filter_order", "step", (F.col("all") - at("rows", after)).alias("kept"), gone("rows").alias("removed"),
                        (at("rows", F.col("own")) - gone("rows")).alias("redundant"),
                        (at("rows", F.lit(full)) - at("rows", F.lit(full) - F.col("own"))).alias("unique_fails"),
                        gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.get("values", who).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The five filters over ``docs``, with ``labels (doc_id, quality, toxic)``."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(one("quality"), one("toxic"))
    rows = failing(docs, part).join(known, "doc_id", "left")
    count = lambda c: F.sum(F.col("copies") * F.coalesce(F.col(c), F.lit(0)))
    cells = rows.groupBy("part", "mask").agg(F.sum("copies").alias("rows"), count("quality").alias("good"), count("toxic").alias("toxic"))
    return interactions(cells)


_BITS = [(f, 1 << i) for i, f in enumerate(FILTERS)]
_PERMUTED = " AND ".join(f"{a}.f <> {b}.f" for i, a in enumerate("vwxyz") for b in "vwxyz"[:i])

ORACLE_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
flags AS (SELECT doc_id, part, len(words) < {MIN_WORDS} AS "A", 100 * len(list_distinct(words)) < 50 * len(words) AS "B",
                 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS "C",
                 regexp_matches(text, '[#$%&*|]') AS "D", coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS "E" FROM texts),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, {" + ".join(f'{b} * "{f}"::INT' for f, b in _BITS)} AS mask, count(*) AS n, coalesce(sum(good), 0) AS good,
                 coalesce(sum(toxic), 0) AS toxic FROM flags LEFT JOIN known USING (doc_id) GROUP BY ALL),
filters(f, bit) AS (VALUES {", ".join(f"('{f}', {b})" for f, b in _BITS)}),
orders AS (SELECT v.f || w.f || x.f || y.f || z.f AS filter_order FROM filters v, filters w, filters x, filters y, filters z WHERE {_PERMUTED}),
steps AS (SELECT filter_order, step, f, bit, (SELECT coalesce(sum(g.bit), 0) FROM filters g WHERE instr(filter_order, g.f) < step) AS before
          FROM orders, range(1, 6) r(step), filters WHERE instr(filter_order, f) = step),
counts AS (SELECT part, filter_order, step, f,
                  sum(n) FILTER (mask & (before + bit)::INT = 0) AS kept,
                  sum(n) FILTER (mask & bit <> 0 AND mask & before::INT = 0) AS removed,
                  sum(n) FILTER (mask & bit <> 0 AND mask & before::INT <> 0) AS redundant,
                  sum(n) FILTER (mask = bit) AS unique_fails,
                  sum(good) FILTER (mask & bit <> 0 AND mask & before::INT = 0) AS good_lost,
                  sum(toxic) FILTER (mask & bit <> 0 AND mask & before::INT = 0) AS toxic_lost
           FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in
       ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counts"""
