"""Near duplicates among embeddings: hashing to E8 lattice points, verified by cosine.

Unit vectors are projected to eight dimensions a table, the tables' directions being
orthogonal as far as the vectors' length allows, and decoded to the nearest point of a
scaled E8 lattice. A vector is kept in its own cell and probes the neighbouring cells
whose border is near. What meets in a cell of an equal label is compared.

A pair that meets in several tables or cells counts in the first, which both vectors
tell by themselves, so counts of links are sums, and no row is made for a pair. Equal
vectors are one class with a number. A crowded cell is cut into chunks, and pairs of
chunks are compared in tasks of their own.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from batonflow.llm.text import in_batches
from batonflow.llm.vptree import inner, usable
from batonflow.operators.graph import connected_components
from batonflow.staging import stage

#: At these, a pair of the least cosine is missed in one table with 0.06 and in all with some 3e-8.
TABLES, REACH = 6, 0.1
#: A cell's size, in mean projected distances of a pair of the least cosine.
WIDTH = 2 * 2**0.5
#: Members of a chunk of a cell, and candidate pairs that are compared at a time.
CHUNK, PAIRS = 512, 1 << 14
#: Crowded cells whose number of chunks is broadcast; more are joined by a shuffle.
MOST_CROWDED = 50_000
#: Cells of up to this many members are compared together, larger ones by a matrix product each.
SMALL = 48


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest points of D8: integers with an even sum."""
    near = np.rint(x).reshape(-1, 8)
    off = x.reshape(-1, 8) - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] > 0, 1, -1)
    return near.reshape(x.shape)


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is D8 and D8 moved by a half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=-1) <= ((x - half) ** 2).sum(axis=-1)
    return np.where(nearer[..., None], whole, half)


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8, of squared length 2."""
    rows = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            row = [0.0] * 8
            row[i], row[j] = a, b
            rows.append(row)
    rows += [row for row in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in row) % 2 == 0]
    return np.array(rows)


NEIGHBOURS = _neighbours()


class Lattice:
    """Projections of unit vectors and what they meet; the same for a vector in every task."""

    def __init__(self, dim: int, least: float, tables: int = TABLES, reach: float = REACH, seed: int = 5):
        rng, turned = np.random.default_rng(seed), []
        wide = max(dim, 8)
        while sum(x.shape[1] for x in turned) < 8 * tables:
            turned.append(_orthonormal(rng.normal(size=(wide, wide))))
        scale = WIDTH * np.sqrt(2 * (1 - least) * 8 / wide)
        self.tables, self.reach = tables, reach
        self.turn = np.hstack(turned)[:dim, : 8 * tables] / max(scale, 1e-12)

    def points(self, units: np.ndarray) -> np.ndarray:
        """(row, table, 8), summed in the order of the components."""
        out = np.zeros((len(units), self.turn.shape[1]))
        for j in range(units.shape[1]):
            out += units[:, j, None] * self.turn[j]
        return out.reshape(len(units), self.tables, 8)

    def probes(self, points: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, neighbour) of the cells beside a table's own whose border is within reach."""
        return np.nonzero((points - cells) @ NEIGHBOURS.T >= 1 - 2**0.5 * self.reach)

    def meets(self, x: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether points `x` of cells `own` are kept in the cells `other` or probe them."""
        step = other - own
        apart = (step**2).sum(axis=-1)
        return (apart == 0) | (apart < 2.5) & (((x - own) * step).sum(axis=-1) >= 1 - 2**0.5 * self.reach)


def _orthonormal(rows: np.ndarray) -> np.ndarray:
    """Columns at right angles, by Gram and Schmidt, twice for the rounding; without BLAS, so equal everywhere."""
    out = np.zeros_like(rows)
    for i in range(rows.shape[1]):
        v = rows[:, i]
        for _ in range(2):
            for j in range(i):
                v = v - (out[:, j] * v).sum() * out[:, j]
        out[:, i] = v / np.sqrt((v * v).sum())
    return out


def _keys(cells: np.ndarray) -> np.ndarray:
    """A cell's doubled components as the eight bytes of a long."""
    return np.ascontiguousarray((2 * cells).astype(np.int64).astype(np.int8)).view(np.int64).ravel()


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """By powers of two, so that squares of very large and small components stay in range and no cosine changes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0))[1][:, None])


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(inner(vectors, vectors))[:, None]


def _members(shared, dim: int, with_vectors: bool):
    """Rows of (node, times, v, label) as a row for each cell that they are kept in or probe."""

    def run(batches):
        lattice = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):  # 17 or so rows with a vector each
                part = batch.slice(a, 1024)
                v = part["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                points = lattice.points(_units(_scaled(v)))
                who, table, cell, owner = [], [], [], []
                for t in range(lattice.tables):
                    own = decode(points[:, t])
                    row, beside = lattice.probes(points[:, t], own)
                    who += [np.arange(len(v)), row]
                    cell += [_keys(own), _keys(own[row] + NEIGHBOURS[beside])]
                    owner += [np.ones(len(v), bool), np.zeros(len(row), bool)]
                    table.append(np.full(len(v) + len(row), t))
                who = np.concatenate(who)
                at = pa.array(who)
                columns = {"label": part["label"].take(at), "table": pa.array(np.concatenate(table), pa.int32()), "cell": pa.array(np.concatenate(cell)), "owner": pa.array(np.concatenate(owner))}
                if with_vectors:
                    columns |= {"node": part["node"].take(at), "times": part["times"].take(at), "v": part["v"].take(at)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


class _Met:
    """Rows that met in cells: sums over the links that count here. No list of pairs is kept."""

    def __init__(self, lattice: Lattice, least: float, table, owner, part, node, times, v):
        self.lattice, self.least, self.table, self.owner, self.part, self.node, self.times, self.v = lattice, least, table, owner, part, node, times, v
        self.units = _units(v)
        self.length = np.sqrt(inner(v, v))
        self.points = self.cells = None
        self.nodes, self.place = np.unique(node, return_inverse=True)
        self.links = np.zeros(len(self.nodes), np.int64)
        self.root = np.arange(len(self.nodes))

    def small(self, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> None:
        """All pairs with an owner of many small cells, in steps of a bounded number."""
        end = np.repeat(ends, ends - starts)
        rows = np.concatenate([np.arange(a, z) for a, z in zip(starts, ends, strict=True)]) if len(starts) else np.empty(0, np.int64)
        one = np.repeat(whole, ends - starts)
        many = end - rows - 1
        total = np.cumsum(many)
        i = 0
        while i < len(rows):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, side="right")))
            n = many[i:j]
            a = np.repeat(rows[i:j], n)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            keep = (self.owner[a] | self.owner[b]) & (np.repeat(one[i:j], n) | (self.part[a] != self.part[b]))
            self._look(a[keep], b[keep])
            i = j

    def large(self, start: int, end: int, whole: bool) -> None:
        step = max(1, PAIRS // (end - start))
        for i in range(start, end, step):
            rows = np.arange(i, min(end, i + step))
            a, b = np.nonzero(self.units[rows] @ self.units[i:end].T >= self.least - 1e-9)
            a, b = rows[a], b + i
            keep = (a < b) & (self.owner[a] | self.owner[b]) & (whole | (self.part[a] != self.part[b]))
            self._look(a[keep], b[keep])

    def _look(self, a: np.ndarray, b: np.ndarray) -> None:
        for i in range(0, len(a), PAIRS):
            x, y = a[i : i + PAIRS], b[i : i + PAIRS]
            cosine = inner(self.v[x], self.v[y]) / (self.length[x] * self.length[y])
            keep = (cosine >= self.least) & (self.node[x] != self.node[y])
            x, y = x[keep], y[keep]
            if len(x):
                keep = self._counts(x, y)
                x, y = x[keep], y[keep]
                px, py = self.place[x], self.place[y]
                np.add.at(self.links, px, self.times[y])
                np.add.at(self.links, py, self.times[x])
                self.root = _roots(self.root[px], self.root[py], len(self.nodes))[self.root]

    def _counts(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the first table and cell of a link is where it met."""
        if self.points is None:
            self.points = self.lattice.points(self.units)
            self.cells = decode(self.points)
        points, cells, here = self.points, self.cells, self.table[x]
        counts, before = np.zeros(len(x), bool), np.zeros(len(x), bool)
        both = self.owner[x] & self.owner[y]
        for t in range(self.lattice.tables):
            to = self.lattice.meets(points[x, t], cells[x, t], cells[y, t])
            back = self.lattice.meets(points[y, t], cells[y, t], cells[x, t])
            # Where each probes the other's cell, the one of the smaller node does.
            probes = np.where(self.owner[y], to, back)
            other = np.where(self.owner[y], back & (self.node[y] < self.node[x]), to & (self.node[x] < self.node[y]))
            counts |= (here == t) & ~before & np.where(both, to, probes & ~other)
            before |= to | back
        return counts


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of the n places that each is linked to, over any number of links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compared(shared, dim: int, least: float):
    """Rows sorted by cell and pair of chunks: (node, links, root) of those with links. A cell that isn't over waits for the next batch."""
    keys = ["label", "table", "cell", "lo", "hi"]

    def links(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        n = table.num_rows
        fresh = np.zeros(n, bool)
        fresh[0] = True
        for key in keys:
            code = table[key].combine_chunks().dictionary_encode() if key == "label" else table[key].combine_chunks()
            values = (code.indices if key == "label" else code).to_numpy()
            fresh[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(fresh)
        ends = np.append(starts[1:], n)
        if not last:
            starts, ends = starts[:-1], ends[:-1]
        over = int(ends[-1]) if len(ends) else 0
        rest = table.slice(over)
        if not over:
            return None, rest
        column = lambda name: table[name].combine_chunks().slice(0, over).to_numpy(zero_copy_only=False)
        held = np.add.reduceat(column("owner").astype(np.int64), starts) > 0
        size = ends - starts
        whole = (column("lo") == column("hi"))[starts]
        go = held & (size > 1)
        if not go.any():
            return None, rest
        v = table["v"].combine_chunks().slice(0, over).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        met = _Met(shared.value, least, column("table"), column("owner"), column("part"), column("node"), column("times"), _scaled(v))
        some = go & (size <= SMALL)
        met.small(starts[some], ends[some], whole[some])
        for i in np.flatnonzero(go & (size > SMALL)):
            met.large(int(starts[i]), int(ends[i]), bool(whole[i]))
        found = np.flatnonzero(met.links)
        if not len(found):
            return None, rest
        return pa.RecordBatch.from_arrays([pa.array(met.nodes[found]), pa.array(met.links[found]), pa.array(met.nodes[met.root[found]])], names=["node", "links", "root"]), rest

    def run(batches):
        waits = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            waits = table if waits is None else pa.concat_tables([waits, table])
            if waits.num_rows:
                found, waits = links(waits, False)
                if found is not None:
                    yield found
        if waits is not None and waits.num_rows:
            found, _ = links(waits, True)
            if found is not None:
                yield found

    return run


def _chunked(members: DataFrame, counts: DataFrame, chunk: int) -> DataFrame:
    """`members` with part, lo and hi: the pairs of chunks of a cell that a row is compared in. One pair, 0 and 0, unless the cell is crowded."""
    zero = F.lit(0)
    crowded = stage(counts.where(F.col("n") > chunk), "crowded")
    many = crowded.limit(MOST_CROWDED + 1).count()
    if not many:
        return members.withColumns({"part": zero, "lo": zero, "hi": zero})
    pieces = lambda n: F.ceil(F.col(n) / chunk).cast("int")
    crowded = crowded.select(F.col("label").alias("_label"), F.col("table").alias("_table"), F.col("cell").alias("_cell"), pieces("owners").alias("_own"), F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("owners")) / chunk)).cast("int").alias("_probe"))
    crowded = F.broadcast(crowded) if many <= MOST_CROWDED else crowded
    met = members.join(crowded, (F.col("label") == F.col("_label")) & (F.col("table") == F.col("_table")) & (F.col("cell") == F.col("_cell")), "left")
    at = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), n).cast("int")
    part = F.when(F.col("_own").isNull(), zero).when(F.col("owner"), at(F.col("_own"))).otherwise(F.col("_own") + at(F.col("_probe")))
    met = met.withColumn("part", part)
    # An owner meets every chunk, a prober those of owners; no owners, no comparison.
    others = F.when(F.col("_own").isNull(), F.array(zero)).when(F.col("_own") == 0, F.array().cast("array<int>")).when(F.col("owner"), F.sequence(zero, F.col("_own") + F.col("_probe") - 1)).otherwise(F.sequence(zero, F.col("_own") - 1))
    met = met.withColumn("_other", F.explode(others))
    return met.withColumns({"lo": F.least("part", "_other"), "hi": F.greatest("part", "_other")}).select(*members.columns, "part", "lo", "hi")


def near_duplicates(vectors: DataFrame, least: float = 0.98, tables: int = TABLES, reach: float = REACH, chunk: int = CHUNK, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row.

    Two rows link if their labels are equal and not null and their cosine is `least` or
    more. component_id is the least vec_id that links reach, itself included; kept says
    that it is its own. Rows whose vector is null, zero or holds null or non-finite
    components, or has another length than the most frequent one (of equally frequent
    ones the least), and rows without a label link with nothing, nor do rows without an
    id, whose component is null and which are kept. Repeated rows are rows each, so
    equal ones link. An empty table gives an empty result. Other columns are not read.
    No pair below `least` is linked; one above it is missed with the odds at TABLES.
    """
    v = F.col(vector).cast("array<double>")
    rows = in_batches(vectors).select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), v.alias("v"))
    part = F.coalesce(usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    some = rows.where(part)
    classes = some.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    lengths = classes.groupBy(F.size("v").alias("d")).agg(F.sum("times").alias("n")).orderBy(F.desc("n"), "d").first()
    alone = lambda df: df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if lengths is None:
        return alone(rows)
    dim = lengths["d"]
    shared = vectors.sparkSession.sparkContext.broadcast(Lattice(dim, least, tables, reach))
    fit, kind = classes.where(F.size("v") == dim), rows.schema["label"].dataType.simpleString()
    head = f"label {kind}, table int, cell long, owner boolean"
    counts = fit.mapInArrow(_members(shared, dim, False), head).groupBy("label", "table", "cell").agg(F.sum(F.col("owner").cast("int")).alias("owners"), F.count("*").alias("n"))
    members = fit.mapInArrow(_members(shared, dim, True), f"{head}, node long, times long, v array<double>")
    by = ["label", "table", "cell", "lo", "hi"]
    met = _chunked(members, counts, chunk).repartition(*by).sortWithinPartitions(*by)
    links = stage(met.mapInArrow(_compared(shared, dim, least), "node long, links long, root long"), "links")
    reached = connected_components(links, "node", "root")
    nodes = classes.join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(reached, "node", "left")
    nodes = stage(nodes.select("label", "v", "least", "times", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")), "nodes")
    heads = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = nodes.join(heads, "component").select(F.col("label").alias("_label"), F.col("v").alias("_v"), (F.col("links") + F.col("times") - 1).alias("n_links"), "component_id")
    linked = some.join(of_class, (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v")))
    # Vectors of another length are classes too, without links; their equal rows don't link either.
    odd = F.size("v") != dim
    linked = linked.select("vec_id", F.when(odd, 0).otherwise(F.col("n_links")).alias("n_links"), F.when(odd, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return linked.withColumn("kept", F.col("vec_id") == F.col("component_id")).union(alone(rows.where(~part)))
