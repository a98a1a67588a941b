"""Approximate nearest neighbours with balanced posting lists.

A bounded sample is clustered hierarchically into lists of about equal size;
the centroids and a neighbour graph over them stay in memory (at most
``MAX_LISTS`` centroids, broadcast). Every vector finds its nearest centroids
by walking the graph and joins the list of the nearest one; a vector near a
boundary joins the lists of other centroids too whose distance is within
``REPLICATE`` of the nearest. A query walks
the same graph and reads the lists whose centroids are within ``PRUNE`` times
the nearest centroid's distance, ``PROBES`` lists at least; the walk widens
until it has passed that distance, so it visits the centroids near the query only.

Every list is split into shards of a bounded number of vectors, and the
queries that read a list into blocks of a bounded size, so a hot list (many
equal vectors, or many equal queries) is many small tasks. Each task computes
exact distances in double precision on the original vectors and returns the
nearest ``k`` per query of its shard; a last grouping keeps the nearest ``k``
of all, replicas counted once. A query whose lists hold too few vectors is
searched again in all lists.

Defined results for odd input: vectors that are NULL, empty, all zero or hold
NULL or non-finite components take no part, neither as query nor as
candidate, nor do vectors without id or of another dimension than most; rows
with a query's id are its own and no candidates; of repeated rows with one id
each is a candidate once, the nearest counts; fewer candidates than ``k``
give all; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tabulare.llm.common import materialize, md5_key

K = 10
QUERY_STEP = 100           # rows whose id it divides are queries
LIST_SIZE = 256            # vectors a list holds on average, until there are MAX_LISTS lists
MAX_LISTS = 1 << 16        # centroids the driver and each task hold; beyond 16 million vectors lists grow instead
SAMPLE = 20_000            # vectors the centroids are fitted on, or
PER_LIST = 4               # ... as many per list, if that is more (so 262,144 at most)
DEGREE = 24                # graph neighbours of a centroid
AHEAD = 2                  # nearest centroids a walk goes on from, however far
SLACK = 1.15               # a walk for lists goes this much beyond the ratio they are pruned by
BEAM = 96                  # centroids kept while walking the graph
REPLICAS = 3               # lists a vector may join
REPLICATE = 1.03           # distance ratio to the nearest centroid within which it does
PROBES = 32                # lists a query reads at least
PRUNE = 1.12               # distance ratio to the nearest centroid within which it reads more, without a cap
SHARD = 1024               # vectors of a list in one task
BLOCK = 512                # queries of a list in one task
WALKS = 512                # walks through the graph at a time


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def balanced_centroids(sample: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Centroids by repeated splitting of the largest cluster, halves kept even by weight."""
    rng = np.random.default_rng(seed)
    points, weight = np.unique(sample, axis=0, return_counts=True)
    clusters = {0: np.arange(len(points))}
    heap = [(-int(weight.sum()), 0)]               # the heaviest cluster that can be split
    while len(clusters) < lists and heap:
        at = heapq.heappop(heap)[1]
        c = clusters[at]
        if len(c) < 2:
            continue
        x, w = points[c], weight[c].astype(float)
        a, b = x[rng.choice(len(c), 2, replace=False)]
        for _ in range(8):
            lean = _sq(x, np.stack([a, b])) @ np.array([1.0, -1.0])
            order = np.argsort(lean, kind="stable")
            reach = np.cumsum(w[order])
            # a balanced cut: between a third and two thirds of the weight, where the sign changes if possible
            sign = np.searchsorted(lean[order], 0.0)
            lo, hi = np.searchsorted(reach, reach[-1] / 3) + 1, np.searchsorted(reach, 2 * reach[-1] / 3)
            cut = min(max(int(np.clip(sign, lo, max(lo, hi))), 1), len(c) - 1)
            left, right = order[:cut], order[cut:]
            a = np.average(x[left], axis=0, weights=w[left])
            b = np.average(x[right], axis=0, weights=w[right])
        for k, part in ((at, c[left]), (len(clusters), c[right])):
            clusters[k] = part
            heapq.heappush(heap, (-int(weight[part].sum()), k))
    return np.stack([np.average(points[c], axis=0, weights=weight[c]) for c in clusters.values()])


@dataclass
class CentroidGraph:
    """Centroids with their nearest neighbours; walked best-first, many queries at a time."""

    centroids: np.ndarray
    neighbours: np.ndarray
    entries: np.ndarray

    @staticmethod
    def build(centroids: np.ndarray) -> CentroidGraph:
        n = len(centroids)
        near = np.empty((n, min(DEGREE, n)), np.int64)
        for i in range(0, n, 512):
            if n <= DEGREE:
                near[i:i + 512] = np.arange(n)
                continue
            d = _sq(centroids[i:i + 512], centroids)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            near[i:i + 512] = np.argpartition(d, DEGREE - 1, axis=1)[:, :DEGREE]
        # reverse edges; a walk starts at the nearest of some centroids that are far from each other, in every cluster of them
        back: list[list[int]] = [[] for _ in range(n)]
        for i, row in enumerate(near.tolist()):
            for j in row:
                if len(back[j]) < DEGREE:
                    back[j].append(i)
        both = np.array([row + b + [row[0]] * (DEGREE - len(b)) for row, b in zip(near.tolist(), back)])
        hubs, far = [0], _sq(centroids[:1], centroids)[0]
        while len(hubs) < min(n, 16 + 2 * math.isqrt(n)):
            hubs.append(int(far.argmax()))
            far = np.minimum(far, _sq(centroids[hubs[-1:]], centroids)[0])
        return CentroidGraph(centroids, both, np.unique(hubs))

    def search(self, x: np.ndarray, want: int, ratio: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of about the ``want`` nearest centroids of each row, nearest first.

        The walk goes on from the nearest ``AHEAD`` centroids it knows, and from
        others only while they are within ``ratio`` times the nearest one's distance.
        """
        n, beam = len(self.centroids), min(max(BEAM, want), len(self.centroids))
        if not len(x):
            return np.empty((0, min(want, n)), np.int64), np.empty((0, min(want, n)))
        rows = np.arange(len(x))[:, None]
        seen = np.zeros((len(x), n), bool)
        ids = np.broadcast_to(self.entries, (len(x), len(self.entries)))
        seen[rows, ids] = True
        dist = self._far(x, ids)
        done = np.zeros(ids.shape, bool)
        while True:
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, done = (np.take_along_axis(a, order, 1) for a in (ids, dist, done))
            open_ = ~done & np.isfinite(dist) & ((dist <= ratio * ratio * dist[:, :1]) | (np.arange(dist.shape[1]) < AHEAD))
            if not open_.any():
                break
            # expand the nearest few open centroids of every row
            pick = np.argsort(~open_, axis=1, kind="stable")[:, :4]
            live = np.take_along_axis(open_, pick, 1)
            np.put_along_axis(done, pick, True, 1)
            more = self.neighbours[np.take_along_axis(ids, pick, 1)]
            more = np.where(live[:, :, None], more, -1).reshape(len(x), -1)
            more = np.sort(more, axis=1)
            fresh = (more >= 0) & np.c_[np.ones((len(x), 1), bool), more[:, 1:] != more[:, :-1]]
            fresh &= ~seen[rows, np.maximum(more, 0)]
            r, c = np.nonzero(fresh)
            seen[r, more[r, c]] = True
            width = fresh.sum(1).max() if len(r) else 0
            if width:
                slot = (np.cumsum(fresh, axis=1) - 1)[r, c]
                new = np.zeros((len(x), width), np.int64)
                far = np.full((len(x), width), np.inf)
                new[r, slot] = more[r, c]
                far[r, slot] = ((x[r] - self.centroids[more[r, c]]) ** 2).sum(1)
                ids, dist = np.c_[ids, new], np.c_[dist, far]
                done = np.c_[done, np.zeros((len(x), width), bool)]
        return ids[:, :want], np.sqrt(dist[:, :want])

    def _far(self, x, ids):
        return ((x[:, None, :] - self.centroids[ids]) ** 2).sum(2)

    def lists_of(self, x: np.ndarray) -> list[np.ndarray]:
        """Lists each vector joins: the nearest, and for a boundary vector those about as near."""
        ids, dist = self.search(x, REPLICAS)
        return [i[d <= REPLICATE * d[0]] for i, d in zip(ids, dist)]

    def probes_of(self, x: np.ndarray) -> list[np.ndarray]:
        """Lists each query reads."""
        n, want, rows = len(self.centroids), 2 * PROBES, np.arange(len(x))
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(x)
        while len(rows):
            ids, dist = self.search(x[rows], want, PRUNE * SLACK)
            # the walk has passed the last list to read, or there is no more to find
            over = (dist[:, -1] > PRUNE * dist[:, 0]) | (want >= n)
            for row, i, d in zip(rows[over], ids[over], dist[over]):
                out[row] = i[np.isfinite(d) & ((d <= PRUNE * d[0]) | (np.arange(len(d)) < PROBES))]
            rows, want = rows[~over], 2 * want
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` of the vectors that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", F.col("embedding").alias("v"))
    v = v.where((F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    size = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("v") == (size["n"] if size else 0))


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.empty((0, 1))


def _spread(rows: DataFrame, graph, way: str) -> DataFrame:
    """``vec_id, v, list`` for every list that ``way`` of the graph gives a vector."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), WALKS):
                df = whole.iloc[at:at + WALKS]
                lists = getattr(graph.value, way)(_matrix(df["v"]))
                yield df.assign(list=lists).explode("list").astype({"list": "int32"})
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInPandas(run, f"vec_id {kinds['vec_id']}, v {kinds['v']}, list int")


def _nearest(k: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(queries):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})
        candidates = candidates.sort_values("vec_id", kind="stable")
        c, ids = _matrix(candidates["v"]), candidates["vec_id"].to_numpy()
        out = []
        for q, x in zip(queries["vec_id"].to_numpy(), _matrix(queries["v"])):
            d = np.sqrt(((c - x) ** 2).sum(axis=1))
            d[ids == q] = np.inf
            top = np.argsort(d, kind="stable")         # ids ascend, so ties go to the smaller id
            top = top[np.isfinite(d[top])]
            _, first = np.unique(ids[top], return_index=True)
            top = top[np.sort(first)[:k]]
            out.append(pd.DataFrame({"query_id": q, "vec_id": ids[top], "score": d[top]}))
        return pd.concat(out)
    return run


def _search(postings: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score``: the ``k`` nearest of each query in every shard it reads."""
    size = materialize(postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards")), "ann-shards")
    blocks = materialize(probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "ann-blocks")
    plan = F.broadcast(size.join(blocks, "list"))                     # a row per list: at most MAX_LISTS
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    c = postings.join(plan, "list").select("list", part("shards").alias("shard"), each("blocks").alias("block"), "vec_id", "v")
    q = probes.join(plan, "list").select("list", each("shards").alias("shard"), part("blocks").alias("block"), "vec_id", "v")
    by = ["list", "shard", "block"]
    return c.groupBy(*by).cogroup(q.groupBy(*by)).applyInPandas(_nearest(k), "query_id long, vec_id long, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest vectors of each query, nearest first."""
    spark = vectors.sparkSession
    good = materialize(usable(vectors), "ann-vectors")
    asked = materialize(usable(queries), "ann-queries") if queries is not vectors else good
    n = good.count()
    lists = max(1, min(MAX_LISTS, n // LIST_SIZE))
    sample = good.orderBy(md5_key(F.col("vec_id"), "ann"), "vec_id").limit(max(SAMPLE, PER_LIST * lists))
    sample = _matrix(sample.select("v").toPandas()["v"])
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    graph = spark.sparkContext.broadcast(CentroidGraph.build(balanced_centroids(np.unique(sample, axis=0) if lists == 1 else sample, lists)))
    postings = materialize(_spread(good, graph, "lists_of"), "ann-postings")
    probes = materialize(_spread(asked, graph, "probes_of"), "ann-probes")
    best = W.partitionBy("query_id").orderBy("score", "vec_id")

    def ranked(found):
        one = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return one.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    result = materialize(ranked(_search(postings, probes, k)), "ann-found")
    # queries that found fewer than k although there are more candidates: all lists
    full = result.groupBy("query_id").count().where(F.col("count") >= k)
    short = materialize(asked.join(full, asked["vec_id"] == full["query_id"], "left_anti"), "ann-short")
    if n > k and not short.isEmpty():
        every = short.select("vec_id", "v", F.explode(F.lit(list(range(len(graph.value.centroids))))).alias("list"))
        again = ranked(_search(postings, every, k))
        result = result.join(short, result["query_id"] == short["vec_id"], "left_anti").unionByName(again)
    return result.select("query_id", "rank", "vec_id", "score")


def search_every(vectors: DataFrame, step: int = QUERY_STEP, k: int = K) -> DataFrame:
    """The search with every row whose id ``step`` divides as a query."""
    return search(vectors, vectors.where(F.col("vec_id") % step == 0), k)
