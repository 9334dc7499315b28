"""Exact top-k inner products by dual-tree search over cover trees.

Queries and data are both indexed by cover trees: a node covers its points within a radius of
its centre, one of those points; the children of a node halve the radius, and their centres
lie apart by more than it. For a query node and a data node no inner product exceeds
``q.x + |q| rx + |x| rq + rq rx``; a pair is dropped when that is below the worst kth score of
the query node's queries. Ties are never dropped, so results are exact.

Data is dealt by a hash of vec_id and indexed in blocks of ``BLOCK`` rows inside the tasks; a
task keeps the best k of each query over its blocks. Queries are the stated set, sent in
blocks of about ``QUERIES`` rows.

Vectors that are null, empty or hold null or non-finite components take no part. Vectors of
different lengths are not compared. Equal rows ask once, rows of one vec_id with different
vectors each, and every row answers; a query never meets rows of its own vec_id. Scores are exact integers and saturate at
the limits of a long. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

K = 10
BLOCK = 4096
LEAF = 48
QUERIES = 20_000
EVERY = 100
SCALE = 1024
HITS = T.StructType([T.StructField("asked", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
_LONG = (-(1 << 63), (1 << 63) - 1)


class CoverTree:
    """Nodes as arrays: centre, its norm, covering radius, children and, in leaves, points."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x
        self.centre, self.radius, self.children, self.points = [], [], [], []
        all_points = np.arange(len(x))
        self._add(0, all_points, self._far(all_points, 0))
        waiting = [(0, all_points)]
        while waiting:
            node, points = waiting.pop()
            if len(points) <= leaf or self.radius[node] == 0:
                self.points[node] = points
                continue
            reach, left, kids = self.radius[node] / 2, points, []
            centre, far = self.centre[node], self._far(points, self.centre[node])
            while len(left):
                near = far <= reach
                own = left[near]
                child = self._add(centre, own, far[near])
                kids.append(child)
                waiting.append((child, own))
                left, nearest = left[~near], far[~near]
                if len(left):
                    centre = left[int(np.argmax(nearest))]
                    far = self._far(left, centre)
            self.children[node] = np.array(kids)
        self.centres = x[self.centre]
        self.norms = np.linalg.norm(self.centres, axis=1)
        self.radii = np.array(self.radius)

    def _far(self, points: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((self.x[points] - self.x[centre]) ** 2).sum(axis=1))

    def _add(self, centre: int, points: np.ndarray, far: np.ndarray) -> int:
        self.centre.append(int(centre))
        self.radius.append(float(far.max(initial=0)))
        self.children.append(None)
        self.points.append(None)
        return len(self.centre) - 1

    def below(self, node: int) -> np.ndarray:
        if self.children[node] is None:
            return self.points[node]
        return np.concatenate([self.below(c) for c in self.children[node]])


class Best:
    """The k best of every query: scores descending, then ids ascending."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.exact = np.full((n, k), None, object)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray, exact: np.ndarray | None) -> None:
        ok = scores >= self.score[q, -1]
        if not ok.any():
            return
        s, i = np.concatenate((self.score[q], scores[ok])), np.concatenate((self.id[q], ids[ok]))
        if exact is None:
            order = np.lexsort((i, -s))[: self.k]
        else:
            e = np.concatenate((self.exact[q], exact[ok]))
            order = np.array(sorted(range(len(s)), key=lambda t: (e[t] is None, -(e[t] or 0), i[t]))[: self.k])
            self.exact[q] = e[order]
        self.score[q], self.id[q] = s[order], i[order]


def dual_search(queries: CoverTree, query_ids: np.ndarray, data: CoverTree, ids: np.ndarray, best: Best, exact: bool) -> None:
    """Brings best up to date with the points of data."""

    def bounds(q: int, nodes: np.ndarray) -> np.ndarray:
        rq, nq = queries.radii[q], queries.norms[q]
        slack = nq * data.radii[nodes] + data.norms[nodes] * rq + rq * data.radii[nodes]
        top = data.centres[nodes] @ queries.centres[q] + slack
        return top + 1e-9 * (nq * data.norms[nodes] + slack) + 1e-6  # rounding is relative to the lengths

    def worst(q: int) -> float:
        return best.score[members[q], -1].min()

    members = {q: queries.below(q) for q in range(len(queries.centre))}
    waiting = [(0, np.array([0]))]
    while waiting:
        q, nodes = waiting.pop()
        top = bounds(q, nodes)
        nodes = nodes[(top >= worst(q))][np.argsort(-top[top >= worst(q)], kind="stable")]
        if not len(nodes):
            continue
        if queries.children[q] is not None and queries.radii[q] >= data.radii[nodes].max() / 2:
            waiting += [(int(c), nodes) for c in queries.children[q]]
            continue
        leaves = np.array([data.children[n] is None for n in nodes])
        deeper = [data.children[n] for n in nodes[~leaves]]
        if leaves.any() and queries.children[q] is not None:
            waiting += [(int(c), nodes[leaves]) for c in queries.children[q]]
        if deeper:
            waiting.append((q, np.concatenate(deeper)))
        if leaves.any() and queries.children[q] is None:
            ready = nodes[leaves]
            while len(ready):
                size = np.cumsum([len(data.points[n]) for n in ready])
                now = max(1, int(np.searchsorted(size, 1024)))
                points = np.concatenate([data.points[n] for n in ready[:now]])
                scores = queries.x[members[q]] @ data.x[points].T
                for i, own in enumerate(members[q]):
                    other = ids[points] != query_ids[own]
                    sums = None
                    if exact:
                        sums = np.array([sum(int(a) * int(b) for a, b in zip(queries.x[own], data.x[p], strict=True)) for p in points[other]], object)
                    best.offer(own, scores[i][other] if sums is None else sums.astype(np.float64), ids[points[other]], sums)
                ready = ready[now:]
                ready = ready[bounds(q, ready) >= worst(q)] if len(ready) else ready


def integers(vectors: list) -> np.ndarray:
    """floor(SCALE * x) of vectors of one length, as doubles (exact)."""
    return np.floor(SCALE * np.asarray(vectors, np.float64))


def _usable(vectors: list) -> list[bool]:
    with np.errstate(over="ignore"):
        return [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(np.asarray(v, np.float64) * SCALE).all()) for v in vectors]


def _by_length(ids: list, vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    found: dict[int, tuple[list, list]] = {}
    for i, v, ok in zip(ids, vectors, _usable(vectors), strict=True):
        if ok and i is not None:
            found.setdefault(len(v), ([], []))[0].append(i)
            found[len(v)][1].append(v)
    return {n: (np.array(i, np.int64), integers(v)) for n, (i, v) in found.items()}


def _search(queries, k: int, block: int, block_count: int):
    def run(batches):
        import pyarrow as pa

        asked = {n: (ids, x, CoverTree(x), Best(len(ids), k)) for n, (ids, x) in queries.value.items()}
        number, first = {}, 0  # a row of its own for every query
        for n, (ids, _) in queries.value.items():
            number[n], first = first + np.arange(len(ids)), first + len(ids)
        held: tuple[list, list] = ([], [])

        def flush():
            for n, (ids, x) in _by_length(*held).items():
                if n in asked:
                    query_ids, q, tree, best = asked[n]
                    exact = float(np.abs(x).max()) * float(np.abs(q).max()) * n >= 2**53
                    if exact:
                        best.exact = np.where(best.exact == None, np.where(np.isfinite(best.score), best.score, 0).astype(np.int64).astype(object), best.exact)  # noqa: E711
                        best.exact[~np.isfinite(best.score)] = None
                    dual_search(tree, query_ids, CoverTree(x), ids, best, exact)
            held[0].clear()
            held[1].clear()

        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                held[0].extend(part.column(0).to_pylist())
                held[1].extend(part.column(1).to_pylist())
                if len(held[0]) >= BLOCK:
                    flush()
        flush()
        for n, (query_ids, _, _, best) in asked.items():
            q, r = np.nonzero(np.isfinite(best.score))
            scores = [min(max(int(best.score[a, b]) if best.exact[a, b] is None else best.exact[a, b], _LONG[0]), _LONG[1]) for a, b in zip(q, r, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(number[n][q] * block_count + block), pa.array(query_ids[q]), pa.array(best.id[q, r]), pa.array(scores, pa.int64())], names=HITS.names)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors (vec_id, embedding) for queries of the same columns."""
    spark = vectors.sparkSession
    pick = (F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = F.expr(f"vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) * {SCALE} < double('Infinity'))")
    vectors, queries = vectors.select(*pick).where(usable), queries.select(*pick).where(usable).distinct()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = -(-queries.count() // QUERIES)
    hits = spark.createDataFrame([], HITS)
    dealt = vectors.repartition(n, F.xxhash64("vec_id", "embedding"))
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)) == b).orderBy("vec_id", "embedding").collect()
        asked = _by_length([r[0] for r in rows], [r[1] for r in rows])
        hits = hits.union(dealt.mapInArrow(_search(spark.sparkContext.broadcast(asked), k, b, blocks), HITS))
    order = Window.partitionBy("asked").orderBy(F.col("score").desc(), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op6(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE6 = """
WITH parts AS (
    SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS k
    FROM embeddings
    WHERE embedding IS NOT NULL
), whole AS (
    SELECT vec_id, k, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS v FROM parts
), scored AS (
    SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(sum(q.v * d.v) AS BIGINT) AS score
    FROM whole q JOIN whole d ON q.k = d.k AND q.vec_id <> d.vec_id
    WHERE q.vec_id % 100 = 0
    GROUP BY q.vec_id, d.vec_id
), ranked AS (
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r
    FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
"""
