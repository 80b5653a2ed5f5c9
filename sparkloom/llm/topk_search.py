"""Exact top-k inner products by a dual-tree search over cover trees.

Vectors are folded to distinct ones, dealt into blocks of neighbouring vectors, and every block of references and
of queries is indexed by a cover tree.  A pair of nodes, one of queries and one of references, is pruned when the
bound on the inner products between them, taken from the centres and covering radii, is below the worst kth score
of the query node.  The same bound between whole blocks says which pairs of blocks are looked at; each block of
queries first meets the block that promises most, which gives the kth scores to prune with.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm._common import pick, written

#: Rows of a reference block and of a query block, about; centres that deal vectors to blocks; tree parameters.
BLOCK, QUERY_BLOCK, MAX_CENTRES, SAMPLE = 4096, 1024, 256, 20_000
LEAF, BASE = 48, 1.25


class CoverTree:
    """A cover tree over the rows of ``points``.

    Node i covers order[first[i] : last[i]], its centre is one of its points, every point of it lies within
    radius[i] of the centre, and siblings' centres are at least scale apart (separation).  Children of a node have
    scales smaller by BASE; a child keeps its parent's centre (nesting).
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points.astype(np.float64)
        self.order = np.arange(len(points))
        self.first, self.last, self.centre, self.radius, self.children = [], [], [], [], []
        if len(points):
            d = np.sqrt(((self.points - self.points[0]) ** 2).sum(1))
            self._grow(0, len(points), 0, d, float(d.max()), leaf)
        self.first, self.last = np.array(self.first, int), np.array(self.last, int)
        self.centre, self.radius = np.array(self.centre, int), np.array(self.radius, float)
        self.norm = np.sqrt((self.points[self.centre] ** 2).sum(1)) if len(points) else np.zeros(0)

    def shape(self) -> bytes:
        """The tree without its points, to be stored beside them."""
        return pickle.dumps((self.order, self.first, self.last, self.centre, self.radius, self.children, self.norm))

    @classmethod
    def restored(cls, points: np.ndarray, shape: bytes) -> CoverTree:
        tree = cls.__new__(cls)
        tree.points = points
        tree.order, tree.first, tree.last, tree.centre, tree.radius, tree.children, tree.norm = pickle.loads(shape)
        return tree

    def _grow(self, a: int, b: int, centre: int, dist: np.ndarray, scale: float, leaf: int) -> int:
        """A node over order[a:b]; dist: of these points to the centre."""
        me = len(self.first)
        self.first.append(a), self.last.append(b), self.centre.append(centre), self.radius.append(float(dist.max())), self.children.append([])
        if b - a <= leaf or dist.max() == 0:
            return me
        rows = self.order[a:b].copy()
        x = self.points[rows]
        while True:
            scale /= BASE
            # a greedy net: the parent's centre first, then the farthest point that no centre covers yet
            near, which, centres, by = dist.copy(), np.zeros(b - a, int), [centre], [dist]
            while len(centres) <= max(2, (b - a) // 3):
                far = int(near.argmax())
                if near[far] <= scale:
                    break
                d = np.sqrt(((x - x[far]) ** 2).sum(1))
                closer = d < near
                which[closer], near[closer] = len(centres), d[closer]
                centres.append(int(rows[far])), by.append(d)
            else:
                return me  # the points are too far apart for a useful net: scan them
            if len(centres) > 1:
                break
        at = a
        for k, c in enumerate(centres):
            mine = np.flatnonzero(which == k)
            self.order[at : at + len(mine)] = rows[mine]
            self.children[me].append(self._grow(at, at + len(mine), c, by[k][mine], scale, leaf))
            at += len(mine)
        return me


def node_bound(q: CoverTree, i: int, r: CoverTree, nodes: list[int]) -> np.ndarray:
    """Upper bounds of the inner products between query node i and reference nodes."""
    dots = r.points[r.centre[nodes]] @ q.points[q.centre[i]]
    return dots + q.radius[i] * r.norm[nodes] + r.radius[nodes] * q.norm[i] + q.radius[i] * r.radius[nodes]


def dual_search(q: CoverTree, r: CoverTree, ids: np.ndarray, own: np.ndarray, best: np.ndarray, best_id: np.ndarray) -> int:
    """Improves ``best`` (scores, worst last) and ``best_id`` of each query by the references of one tree.

    ``ids`` are the reference ids and ``own`` the queries' own ids, which are left out.  Returns the number of
    inner products taken.
    """
    k, taken = best.shape[1], 0
    if not len(q.order) or not len(r.order):
        return 0
    stack = [(0, [0])]
    while stack:
        i, nodes = stack.pop()
        rows = q.order[q.first[i] : q.last[i]]
        nodes = np.array(nodes)
        nodes = nodes[node_bound(q, i, r, nodes) >= best[rows, k - 1].min()].tolist()  # equal scores may win by id
        if not nodes:
            continue
        leaves = [n for n in nodes if not r.children[n]]
        inner = [n for n in nodes if r.children[n]]
        if q.children[i]:
            below = leaves + [c for n in inner for c in r.children[n]]
            stack += [(c, below) for c in q.children[i]]
            continue
        while inner:
            below = np.array([c for n in inner for c in r.children[n]])
            below = below[node_bound(q, i, r, below) >= best[rows, k - 1].min()].tolist()
            leaves += [n for n in below if not r.children[n]]
            inner = [n for n in below if r.children[n]]
        leaves = np.array(leaves)
        bound = node_bound(q, i, r, leaves)
        for part in np.array_split(leaves[np.argsort(-bound, kind="stable")], max(1, len(leaves) // 16)):
            part = part[node_bound(q, i, r, part) >= best[rows, k - 1].min()]
            if not len(part):
                continue
            cols = np.concatenate([r.order[r.first[n] : r.last[n]] for n in part])
            scores = q.points[rows] @ r.points[cols].T
            taken += scores.size
            scores[ids[cols][None, :] == own[rows][:, None]] = -np.inf
            both = np.concatenate([best[rows], scores], 1)
            names = np.concatenate([best_id[rows], np.broadcast_to(ids[cols], scores.shape)], 1)
            order = np.lexsort((names, -both))[:, :k]
            best[rows], best_id[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
    return taken


def quantised(table: DataFrame) -> DataFrame:
    """vec_id, v array<double>: floor(256 * x) of each component; vectors that are null or hold a null, NaN or infinity go."""
    rows = pick(table, "vec_id", "embedding").where("embedding is not null and vec_id is not null")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return rows.where(~bad & (F.size("embedding") > 0)).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _packed(x: np.ndarray) -> bytes:
    """The rows of a block as bytes: small integers in four bytes each, anything else in eight."""
    small = np.abs(x).max(initial=0) < 2**31
    return (b"i" if small else b"d") + x.astype("<i4" if small else "<f8").tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<i4" if data[:1] == b"i" else "<f8", offset=1).reshape(n, -1).astype(np.float64)


def top_k(table: DataFrame, k: int = 5, every: int = 50, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query, exactly.

    ``table`` needs vec_id (long) and embedding (array of numbers, all of one length; another length than most is an
    error).  Queries: rows whose vec_id is divisible by ``every``; candidates: every other row.  Components are
    turned into floor(256 * x).  Ties go to the smaller vec_id.  Vectors that are null, empty or hold a null or
    non-finite component take no part, nor do null ids.  Repeated rows count as one.  A query with fewer than k
    candidates gets all; an empty table gives an empty result.

    Of equal vectors only the k + 1 smallest ids can appear (one may be the query itself); the others are never
    needed, so any number of copies costs one.  Blocks have a bounded number of rows; a crowded cell is dealt to
    several.  The centres that deal vectors to cells come from a bounded sample and decide speed only: every
    vector is indexed and the bounds hold whatever the cells are.  A block's tree is built once and stored with it.

    Scores are summed in doubles: they are exact as long as the squared length of every quantised vector is below
    2^53 (64 components of 46,000 before quantisation); a table beyond that is an error.
    """
    spark = table.sparkSession
    rows = written(quantised(table).distinct(), "vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n_rows, longest = rows.agg(F.count("*"), F.max(squares)).first()
    if longest is not None and longest >= 2.0**53:
        raise ValueError("vectors are too long for exact scores")
    order = Window.partitionBy("v").orderBy("vec_id")
    slim = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1).drop("_n")
    queries = rows.where(F.col("vec_id") % every == 0)

    sample = rows.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("v").toPandas()  # a bounded number of rows
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if sample["v"].map(len).nunique() > 1:
        raise ValueError("vectors differ in length")
    centres = _centres(_matrix(sample["v"]), -(-n_rows // block))
    shared = spark.sparkContext.broadcast(centres)

    def cells(it):
        c = shared.value
        half = (c**2).sum(1) / 2
        for pdf in it:
            if len(pdf):
                yield pdf.assign(cell=(_matrix(pdf["v"]) @ c.T - half).argmax(1))

    def blocked(df: DataFrame, most: int) -> DataFrame:
        """Deals the rows of each cell to as many blocks as its size asks for."""
        dealt = df.mapInPandas(cells, "vec_id long, v array<double>, cell long")
        dealt = written(dealt, "cells")
        need = dealt.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("long").alias("parts"))
        # at most one row for each of the MAX_CENTRES cells
        return dealt.join(F.broadcast(need), "cell").select("vec_id", "v", F.concat_ws("-", "cell", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("block"))

    def summary(name: str):
        def run(key, pdf):
            x = _matrix(pdf["v"])
            mean = x.mean(0)
            return pd.DataFrame({name: [key[0]], f"{name}_mean": [mean.tolist()], f"{name}_radius": [float(np.sqrt(((x - mean) ** 2).sum(1)).max())], f"{name}_ids": [pdf["vec_id"].tolist()], f"{name}_v": [_packed(x)], f"{name}_tree": [CoverTree(x).shape()]})

        return run, f"{name} string, {name}_mean array<double>, {name}_radius double, {name}_ids array<long>, {name}_v binary, {name}_tree binary"

    refs = written(blocked(slim, block).groupBy("block").applyInPandas(*summary("r")), "references")
    asks = written(blocked(queries, query_block).groupBy("block").applyInPandas(*summary("q")), "queries")

    # bounds between blocks: their tables hold a row for thousands of vectors
    heads = refs.select("r", "r_mean", "r_radius")
    dot = F.aggregate(F.zip_with("q_mean", "r_mean", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, b: a + b * b))
    bound = dot + F.col("q_radius") * norm("r_mean") + F.col("r_radius") * norm("q_mean") + F.col("q_radius") * F.col("r_radius")
    pairs = written(asks.select("q", "q_mean", "q_radius").join(heads, F.lit(True)).select("q", "r", dot.alias("promise"), (bound * (1 + 1e-9) + 1e-6).alias("bound")), "bounds")
    seeds = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("promise"), "r"))).where("_n = 1").drop("_n")

    def search(pdf_iter):
        for pdf in pdf_iter:
            for row in pdf.itertuples(index=False):
                own, ids = np.array(row.q_ids), np.array(row.r_ids)
                q = CoverTree.restored(_unpacked(row.q_v, len(own)), row.q_tree)
                r = CoverTree.restored(_unpacked(row.r_v, len(ids)), row.r_tree)
                best = np.full((len(own), k), -np.inf)
                best_id = np.full((len(own), k), np.iinfo(np.int64).max)
                if row.q_worst is not None and len(row.q_worst):
                    # scores below what a query has already cannot enter; equal ones can, by a smaller id
                    best[:] = np.array(row.q_worst)[:, None] - 0.5
                dual_search(q, r, ids, own, best, best_id)
                i, j = np.nonzero((best_id < np.iinfo(np.int64).max) & (best > -np.inf))
                if len(i):
                    yield pd.DataFrame({"q": row.q, "query_id": own[i], "vec_id": best_id[i, j], "score": best[i, j].astype(np.int64)})

    found_schema = "q string, query_id long, vec_id long, score long"
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def run(which: DataFrame, worst: DataFrame | None) -> DataFrame:
        left = asks.select("q", "q_ids", "q_v", "q_tree")
        left = left.join(worst, "q") if worst is not None else left.withColumn("q_worst", F.lit(None).cast("array<double>"))
        return which.select("q", "r").join(left, "q").join(refs.select("r", "r_ids", "r_v", "r_tree"), "r").mapInPandas(search, found_schema)

    first = written(run(seeds, None), "first")
    kth = first.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") == k).select("q", "query_id", "score")
    each = asks.select("q", F.posexplode("q_ids").alias("at", "query_id")).join(kth.drop("q"), "query_id", "left")
    worst = each.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce(F.col("score").cast("double"), F.lit(-1e300)).alias("s")))), lambda x: x["s"]).alias("q_worst"))
    worst = written(worst, "worst")  # an array for each block of queries, as long as the block
    floor = worst.select(F.col("q"), F.array_min("q_worst").alias("floor"))
    rest = pairs.join(floor, "q").where("bound >= floor").join(seeds.select("q", "r"), ["q", "r"], "left_anti")
    every_one = first.unionByName(run(rest, worst))
    best = every_one.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def _centres(x: np.ndarray, wanted: int) -> np.ndarray:
    """One centre for every block of vectors, up to MAX_CENTRES: a few rounds of k-means over the sample."""
    rng = np.random.default_rng(0)
    x = np.unique(x, axis=0)
    c = x[rng.choice(len(x), min(len(x), MAX_CENTRES, max(1, wanted)), replace=False)]
    for _ in range(5):
        which = (x @ c.T - (c**2).sum(1) / 2).argmax(1)
        c = np.stack([x[which == i].mean(0) if (which == i).any() else c[i] for i in range(len(c))])
    return c


def op1_topk(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest of every 50th vector among all others."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v)::BIGINT AS score FROM e q JOIN e r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5
"""
