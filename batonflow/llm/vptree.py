"""Approximate nearest neighbours by inner product: vantage-point trees, one per shard.

Vectors get one more component, so that all have the length of the longest; then
the nearest by Euclidean distance is the one with the largest inner product, and
the triangle inequality holds. A small tree fitted on a bounded sample deals all
vectors to shards by their distances to its vantage points; a shard's own tree is
built where it lies. A query asks its home shard first, and then those whose bound,
times `factor`, isn't beyond its k-th best so far. With factor 1 nothing nearer is
passed over and the search is exact; larger factors prune more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from batonflow.staging import stage

LEAF = 1024
#: Vectors of a shard, queries of a block, vectors in a row of a shard: what a task holds.
SHARD, QUERIES, CHUNK = 16_384, 2048, 1024
#: Of the tree that deals vectors to shards: leaves at most, and sampled vectors a leaf that it is fitted on.
MOST_SHARDS, SAMPLED = 1024, 16
_MARGIN = 8
_ROWS = "shard int, part int, kind int, block int, ids array<long>, v array<double>"


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in the order of the components: the same for equal vectors anywhere."""
    total = np.zeros(max(len(a), len(b)))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def lift(vectors: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
    return np.hstack([vectors, rest[:, None]])


def _distances(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - point) ** 2).sum(axis=1))


class Top:
    """Vantage points that deal lifted vectors to 2**depth shards; what is at a node's border or nearer goes inside."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 5):
        rng, nodes = np.random.default_rng(seed), (1 << depth) - 1
        self.depth, self.points, self.border = depth, np.zeros((nodes, sample.shape[1])), np.zeros(nodes)
        self._fit(0, sample, rng)

    def _fit(self, node: int, rows: np.ndarray, rng) -> None:
        if node >= len(self.points) or not len(rows):
            return
        self.points[node] = rows[rng.integers(len(rows))]
        far = _distances(rows, self.points[node])
        self.border[node] = np.median(far)
        inside = far <= self.border[node]
        self._fit(2 * node + 1, rows[inside], rng)
        self._fit(2 * node + 2, rows[~inside], rng)

    def shard(self, lifted: np.ndarray) -> np.ndarray:
        node = np.zeros(len(lifted), np.int64)
        for _ in range(self.depth):
            far = np.sqrt(((lifted - self.points[node]) ** 2).sum(axis=1))
            node = 2 * node + 1 + (far > self.border[node])
        return node - len(self.points)

    def bounds(self, lifted: np.ndarray) -> np.ndarray:
        """(rows, shards): no vector of the shard is nearer than this, by the borders on the way to it."""
        out = np.zeros((len(lifted), 1))
        for level in range(self.depth):
            nodes = np.arange((1 << level) - 1, (2 << level) - 1)
            far = np.stack([_distances(lifted, self.points[n]) for n in nodes], axis=1) - self.border[nodes]
            out = np.stack([np.maximum(out, far), np.maximum(out, -far)], axis=2).reshape(len(lifted), -1)
        return out


class Tree:
    """Built over points in rows; a node splits its rows by rank of distance to a vantage point, so ties balance too."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 5):
        self.points, self.rows, self.nodes = points, np.arange(len(points)), []
        self._rng = np.random.default_rng(seed)
        self._grow(0, len(points), leaf)

    def _grow(self, a: int, z: int, leaf: int) -> int:
        number = len(self.nodes)
        self.nodes.append(None)
        rows = self.rows[a:z]
        if z - a <= leaf:
            self.nodes[number] = (a, z, None)
            return number
        point = self.points[rows[self._rng.integers(len(rows))]]
        far = _distances(self.points[rows], point)
        order = np.argsort(far, kind="stable")
        self.rows[a:z], far = rows[order], far[order]
        half = (z - a) // 2
        spans = (far[0], far[half - 1], far[half], far[-1])
        self.nodes[number] = (a, z, (point, spans, self._grow(a, a + half, leaf), self._grow(a + half, z, leaf)))
        return number


class Index:
    """One shard: distinct vectors, the smallest ids of each, and the tree over them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, k: int):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        start = np.flatnonzero(fresh)
        # One more than k, as a query's own row doesn't count; ids ascend within a vector.
        self.counts = np.minimum(np.diff(np.append(start, len(ids))), k + 1)
        self.ids, self.start, self.vectors, self.k = ids, start, vectors[start], k
        self.tree = Tree(lift(self.vectors, longest))

    def search(self, own: np.ndarray, queries: np.ndarray, longest: float, factor: float, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query's number, id, score) of at least the k best, and how many (query, vector) pairs were scored.

        `reach`: how far a query's k-th best is already known to lie.
        """
        top = _Best(self, queries, longest, factor, self.k + 1 + _MARGIN, reach)
        who, which = top.candidates()
        times = self.counts[which]
        at = np.repeat(self.start[which] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        who, score, found = np.repeat(who, times), np.repeat(inner(queries[who], self.vectors[which]), times), self.ids[at]
        keep = found != own[who]
        who, score, found = who[keep], score[keep], found[keep]
        order = np.lexsort((found, -score, who))
        who, score, found = who[order], score[order], found[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        keep = rank < self.k
        return who[keep], found[keep], score[keep], top.seen


class _Best:
    """The `most` best vectors of an index for a block of queries, by rounded products; all queries of a node at once."""

    def __init__(self, index: Index, queries: np.ndarray, longest: float, factor: float, most: int, reach: np.ndarray | None):
        self.index, self.q, self.factor, self.most, self.longest, self.seen = index, queries, factor, most, longest, 0
        self.lifted = np.hstack([queries, np.zeros((len(queries), 1))])
        self.length = (queries**2).sum(axis=1)
        self.score = np.full((len(queries), most), -np.inf)
        self.row = np.full((len(queries), most), -1)
        self.known = np.full(len(queries), np.inf) if reach is None else reach
        self.reach = self.known.copy()
        if len(index.vectors):
            self._visit(0, np.arange(len(queries)))

    def _visit(self, number: int, who: np.ndarray) -> None:
        a, z, split = self.index.tree.nodes[number]
        if split is None:
            self._leaf(self.index.tree.rows[a:z], who)
            return
        point, (in_low, in_high, out_low, out_high), inside, outside = split
        d = _distances(self.lifted[who], point)
        low = {inside: np.maximum(np.maximum(d - in_high, in_low - d), 0), outside: np.maximum(np.maximum(d - out_high, out_low - d), 0)}
        nearer = low[inside] <= low[outside]
        for first, pick in ((inside, nearer), (outside, ~nearer)):
            for child in (first, inside + outside - first):
                go = who[pick & (low[child] * self.factor <= self.reach[who] + 1e-9)]
                if len(go):
                    self._visit(child, go)

    def _leaf(self, rows: np.ndarray, who: np.ndarray) -> None:
        self.seen += len(rows) * len(who)
        score = np.hstack([self.score[who], self.q[who] @ self.index.vectors[rows].T])
        row = np.hstack([self.row[who], np.broadcast_to(rows, (len(who), len(rows)))])
        best = np.argpartition(-score, self.most - 1, axis=1)[:, : self.most]
        self.score[who], self.row[who] = np.take_along_axis(score, best, 1), np.take_along_axis(row, best, 1)
        # k + 1 vectors hold k ids other than the query's own.
        kth = np.partition(self.score[who], self.most - self.index.k - 1, axis=1)[:, self.most - self.index.k - 1]
        far = np.sqrt(np.maximum(self.length[who] + self.longest**2 - 2 * kth, 0))
        self.reach[who] = np.minimum(self.known[who], np.where(np.isfinite(kth), far, np.inf))

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """(query's number, vector's row). Where more than `most` could round to a place among the best, all that could are given."""
        kth = np.partition(self.score, self.most - self.index.k - 1, axis=1)[:, self.most - self.index.k - 1]
        edge = np.where(np.isfinite(kth), kth - 1e-9 * np.maximum(1, np.abs(kth)), -np.inf)
        crowded = np.isfinite(self.score.min(axis=1)) & (self.score.min(axis=1) >= edge)
        who, place = np.nonzero((self.row >= 0) & (self.score >= edge[:, None]) & ~crowded[:, None])
        parts = [(who, self.row[who, place])]
        for w in np.flatnonzero(crowded):
            near = np.flatnonzero(self.index.vectors @ self.q[w] >= edge[w])
            parts.append((np.full(len(near), w), near))
        who, which = (np.concatenate(x) for x in zip(*parts, strict=True))
        return who, which


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _dealt(top, dim: int, longest: float):
    def run(batches):
        for batch in batches:
            points = _matrix(batch["v"], dim)
            shard = top.value.shard(lift(points, longest)) if len(points) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32())], names=[*batch.schema.names, "shard"])

    return run


def _searched(dim: int, longest: float, k: int, factor: float, ask_reach: bool):
    """Rows of one (shard, part) come in order: its vectors first, whose tree is built once, then blocks of queries."""

    def run(batches):
        now, ids, vectors, index = None, [], [], None
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch["shard"][i].as_py(), batch["part"][i].as_py()
                if key != now:
                    now, ids, vectors, index = key, [], [], None
                own, v = batch["ids"][i].values.to_numpy(), batch["v"][i].values.to_numpy()
                if batch["kind"][i].as_py() == 0:
                    ids.append(own)
                    vectors.append(v.reshape(-1, dim))
                elif ids:
                    if index is None:
                        index = Index(np.concatenate(ids), np.concatenate(vectors), longest, k)
                    rows = v.reshape(len(own), -1)
                    who, found, score, _ = index.search(own, rows[:, :dim], longest, factor, rows[:, dim].copy() if ask_reach else None)
                    yield pa.RecordBatch.from_arrays([pa.array(own[who]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def _chunked(rows: DataFrame, by: list[str], size: int) -> DataFrame:
    """Rows as (by, block, ids, v), about `size` of a `by` in each and a few times as many at most: their number is counted first."""
    counts = rows.groupBy(*by).agg(F.ceil(F.count("*") / size).cast("int").alias("_n"))
    dealt = rows.join(counts, by).withColumn("block", F.pmod(F.xxhash64("vec_id", "v", F.lit(3)), F.col("_n")).cast("int"))
    packed = dealt.groupBy(*by, "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))
    return packed.select(*by, "block", F.col("rows.vec_id").alias("ids"), F.flatten("rows.v").alias("v"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, shard: int = SHARD, block: int = QUERIES, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest of `vectors` but itself, by inner product.

    Ties go to the smaller id. Vectors that are null, zero or hold null or
    non-finite components take no part, nor do rows with a null id or of another
    length than the most frequent one (of equally frequent ones the least). Fewer
    candidates than k give fewer rows. Repeated rows of an id are candidates each. An
    empty table gives an empty result. Every usable vector is in an index.
    """
    clean = lambda df: df.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    base, asked = stage(clean(vectors), "vectors"), clean(queries)
    lengths = base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("most"))
    common = lengths.orderBy(F.desc("n"), "d").first()
    if common is None:
        return base.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    dim, n, longest = common["d"], common["n"], float(common["most"]) ** 0.5
    base, asked = (df.where(F.size("v") == dim) for df in (base, asked))

    depth = min(MOST_SHARDS.bit_length() - 1, max(0, -(-n // shard) - 1).bit_length())
    sample = base.orderBy(F.xxhash64("vec_id", "v")).limit(max(64, SAMPLED << depth)).select("v").collect() if depth else []
    fitted = Top(lift(np.array([r["v"] for r in sample]).reshape(-1, dim), longest), depth)
    top = base.sparkSession.sparkContext.broadcast(fitted)  # at most MOST_SHARDS vantage points
    schema = "vec_id long, v array<double>, shard int"
    dealt = stage(base.mapInArrow(_dealt(top, dim, longest), schema), "dealt")
    # A shard that got more than its share, such as one vector very many times, is cut into parts by hash.
    counts = dealt.groupBy("shard").agg(F.ceil(F.count("*") / shard).cast("int").alias("parts"))
    parted = dealt.join(F.broadcast(counts), "shard")  # at most MOST_SHARDS rows
    parted = parted.withColumn("part", F.pmod(F.xxhash64("vec_id", "v", F.lit(9)), F.col("parts")).cast("int")).select("shard", "part", "vec_id", "v")
    pick = ["shard", "part", "kind", "block", "ids", "v"]
    shards = stage(_chunked(parted, ["shard", "part"], CHUNK).withColumn("kind", F.lit(0)).select(pick), "shards")

    def ask(rows: DataFrame, ask_reach: bool) -> DataFrame:
        """`rows` (shard, vec_id, v) of queries against all parts of their shards."""
        blocks = _chunked(rows, ["shard"], block).join(F.broadcast(counts), "shard")
        blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("kind", F.lit(1)).select(pick)
        met = shards.union(blocks).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind", "block")
        return met.mapInArrow(_searched(dim, longest, k, factor, ask_reach), "query_id long, vec_id long, score double")

    at_home = stage(asked.mapInArrow(_dealt(top, dim, longest), schema), "asked")
    found = stage(ask(at_home.select("shard", "vec_id", "v"), False), "home")
    if depth:
        # The k-th best at home is how far a query has to look elsewhere. Without k there, everywhere.
        kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min_by("score", F.struct("score")).alias("least"))
        kth = kth.where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "least") if not _repeated(asked) else kth.limit(0).select(F.col("query_id").alias("vec_id"), "least")
        known = at_home.join(kth, "vec_id", "left").select("vec_id", "v", F.col("shard").alias("home"), "least")
        further = known.mapInArrow(_elsewhere(top, dim, longest, factor), schema)
        found = found.union(ask(further.select("shard", "vec_id", "v"), True))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _repeated(asked: DataFrame) -> bool:
    """Whether an id is asked with several vectors, so its k-th best at home is not one vector's."""
    return not asked.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _elsewhere(top, dim: int, longest: float, factor: float):
    """Rows of (query, its vector with its reach as one more component, shard) for the other shards that may hold nearer ones."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, QUERIES):
                part = batch.slice(a, QUERIES)
                v, home = _matrix(part["v"], dim), part["home"].to_numpy()
                least = part["least"].to_numpy(zero_copy_only=False).astype(float)
                length = (v**2).sum(axis=1)
                reach = np.where(np.isnan(least), np.inf, np.sqrt(np.maximum(length + longest**2 - 2 * least, 0)))
                go = top.value.bounds(np.hstack([v, np.zeros((len(v), 1))])) * factor <= reach[:, None] + 1e-9
                go[np.arange(len(v)), home] = False
                who, shard = np.nonzero(go)
                rows = np.hstack([v, reach[:, None]])[who]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(who) + 1) * (dim + 1), pa.int32()), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([part["vec_id"].take(pa.array(who)), lists, pa.array(shard, pa.int32())], names=["vec_id", "v", "shard"])

    return run
