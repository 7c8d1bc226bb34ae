"""Embedding near-duplicates by dual traversal of cover trees: exact links of at least the threshold cosine.

On unit vectors the threshold is a distance. Vectors go to the block of their nearest pivot, and blocks larger than
BLOCK are cut into parts. Each part builds one cover tree: a node's points lie within its radius, and its children are
a net of half that radius, down to nodes of a few points. A tree travels as what it is in depth-first order, an end
and a radius for each node that begins at a point, so it is built once and put together again wherever it is needed.

Two parts meet if their blocks' covering radii let a pair within the threshold exist. Node pairs whose centres are
farther apart than the threshold and both radii are pruned; pairs that lie within the threshold as a whole are counted
without being opened; the others are opened. A task reports how many links each of its vectors has and a spanning
forest of them, never the pairs, so a group of near copies costs rows in proportion to its vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .stage import cut, table
from .textnum import list_array, ranges
from .vectors import matrix, unit_vectors

THRESHOLD = 0.95
BLOCK = 8192
#: Pivots are collected to the driver, 32 MB of them at 64 dimensions. Beyond so many blocks grow, and their parts don't.
MOST_PIVOTS = 65536
#: Vectors of a group of parts at most (of one part, where that is larger); fewer, so that there are LEAST_GROUPS.
GROUP = 16384
LEAST_GROUPS = 12
_LEAF = 8
_BATCH = 256
#: Distances are found in single precision; this is beyond their error, and bounds give way by it.
_SLACK = 8e-3
_HELD = 1 << 20


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a @ b.T
    np.multiply(d, -2, out=d)
    np.add(d, 2, out=d)
    np.maximum(d, 0, out=d)
    return np.sqrt(d, out=d)


class Tree:
    """A cover tree in depth-first order: points, and for each node its first point (the centre), end and radius."""

    def __init__(self, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: np.ndarray):
        self.order, self.lo, self.hi, self.radius = order, lo, hi, radius
        # Nodes come in preorder, so a node's children are the next one and those that begin where a sibling ends.
        parent, stack = np.full(len(lo), -1), []
        ends = hi.tolist()
        for k, begin in enumerate(lo.tolist()):
            while stack and ends[stack[-1]] <= begin:
                stack.pop()
            if stack:
                parent[k] = stack[-1]
            stack.append(k)
        self.parent = parent
        self.kids = np.argsort(parent, kind="stable")[int((parent < 0).sum()) :]
        self.many = np.bincount(parent[parent >= 0], minlength=len(lo))
        self.first = np.cumsum(self.many) - self.many

    def open(self, nodes: np.ndarray) -> np.ndarray:
        """Children of the nodes; a node of a few points gives its points as nodes -1 - place."""
        inner = nodes[self.many[nodes] > 0]
        leaf = nodes[self.many[nodes] == 0]
        n = self.many[inner]
        kids = self.kids[np.repeat(self.first[inner], n) + ranges(n)]
        m = self.hi[leaf] - self.lo[leaf]
        return np.concatenate([kids, -1 - (np.repeat(self.lo[leaf], m) + ranges(m))])

    def shape(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centre's place, end and radius of nodes; points have radius 0."""
        point = nodes < 0
        at = np.where(point, 0, nodes)
        lo = np.where(point, -1 - nodes, self.lo[at])
        single = point | (self.hi[at] - self.lo[at] == 1)
        return lo, np.where(single, lo + 1, self.hi[at]), np.where(single, 0, self.radius[at])


def _net(x: np.ndarray, points: np.ndarray, away: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Each point's nearest centre of a net of the given radius, the distance to it, and how many centres there are."""
    near, owner, n = away.copy(), np.zeros(len(points), np.int64), 1
    left = away > half
    while left.any():
        some = np.flatnonzero(left)[:_BATCH]
        apart = _distances(x[points[some]], x[points[some]])
        free, chosen = np.ones(len(some), bool), []
        for k in range(len(some)):
            if free[k]:
                chosen.append(k)
                free &= apart[k] > half
        some = some[chosen]
        for lo in range(0, len(points), 4096):
            d = _distances(x[points[lo : lo + 4096]], x[points[some]])
            best = d.argmin(axis=1)
            d = d[np.arange(len(d)), best]
            part = slice(lo, lo + 4096)
            better = d < near[part]
            near[part][better], owner[part][better] = d[better], n + best[better]
            left[part] &= d > half
        near[some], owner[some], left[some] = 0, n + np.arange(len(some)), False
        n += len(some)
    near[0], owner[0] = 0, 0
    return owner, near, n


def cover_tree(x: np.ndarray) -> Tree:
    """Cover tree of unit vectors (single precision): each level's centres are a net of half the radius above."""
    order: list[np.ndarray] = []
    nodes: list[list] = []
    placed = 0

    def grow(points: np.ndarray, away: np.ndarray) -> None:
        nonlocal placed
        radius = float(away.max(initial=0))
        me = len(nodes)
        nodes.append([placed, 0, radius])
        if len(points) <= _LEAF or radius <= _SLACK:
            order.append(points)
            placed += len(points)
        else:
            owner, near, n = _net(x, points, away, radius / 2)
            # A child begins with its centre, the point at distance 0 that the net chose first.
            by = np.lexsort((near, owner))
            bounds = np.searchsorted(owner[by], np.arange(n + 1))
            for k in range(n):
                inside = by[bounds[k] : bounds[k + 1]]
                if len(inside) == 1:
                    nodes.append([placed, placed + 1, 0.0])
                    order.append(points[inside])
                    placed += 1
                elif len(inside):
                    grow(points[inside], near[inside])
        nodes[me][1] = placed

    if len(x):
        grow(np.arange(len(x)), _distances(x, x[:1])[:, 0])
    lo, hi, radius = (np.array([n[k] for n in nodes]) for k in range(3)) if nodes else (np.zeros(0, np.int64),) * 3
    return Tree(np.concatenate(order) if order else np.zeros(0, np.int64), lo, hi, radius)


class Links:
    """Links found so far: how many each point has, and a forest that joins what they join."""

    def __init__(self, n: int, weight: np.ndarray):
        self.label, self.weight, self.count = np.arange(n), weight, np.zeros(n, np.int64)
        self.before = np.append(0, np.cumsum(weight))
        self.step = np.zeros(n + 1, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        self.waiting.append((i, j))
        self.held += len(i)
        if self.held > _HELD:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        i, j = (np.concatenate(v) for v in zip(*self.waiting))
        label = self.label
        while True:
            a, b = label[i], label[j]
            some = a != b
            if not some.any():
                break
            i, j, a, b = i[some], j[some], a[some], b[some]
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label[label] != label).any():
                label = label[label]
        self.label, self.waiting, self.held = label, [], 0

    def pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        """Single points, each pair once."""
        np.add.at(self.count, i, self.weight[j])
        np.add.at(self.count, j, self.weight[i])
        self.join(i, j)

    def whole(self, a: int, a_end: int, b: int, b_end: int) -> None:
        """All points of one range with all of another, or of one range with each other (then without itself)."""
        for lo, hi, other_lo, other_hi in ((a, a_end, b, b_end),) if a == b else ((a, a_end, b, b_end), (b, b_end, a, a_end)):
            n = self.before[other_hi] - self.before[other_lo]
            self.step[lo] += n
            self.step[hi] -= n
        if a == b:
            self.count[a:a_end] -= self.weight[a:a_end]
        both = np.arange(a, a_end), np.arange(b, b_end)
        self.join(both[0], np.full(len(both[0]), a))
        self.join(both[1], np.full(len(both[1]), a))

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        return self.label, self.count + np.cumsum(self.step)[:-1]


def _near(sa: np.ndarray, la: np.ndarray, ra: np.ndarray, sb: np.ndarray, lb: np.ndarray, rb: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the pairs of nodes whose centres are within reach and both radii."""
    zero_a, zero_b = np.flatnonzero(ra == 0), np.flatnonzero(rb == 0)
    some_a, some_b = np.flatnonzero(ra > 0), np.flatnonzero(rb > 0)
    for rows, cols in ((zero_a, zero_b), (zero_a, some_b), (some_a, zero_b), (some_a, some_b)):
        if not len(rows) or not len(cols):
            continue
        right = sb[lb[cols]].T
        step = max((1 << 22) // len(cols), 1)
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            dot = sa[la[part]] @ right
            bound = np.float32(reach)
            if rows is some_a:
                bound = bound + ra[part].astype(np.float32)[:, None]
            if cols is some_b:
                bound = bound + rb[cols].astype(np.float32)[None, :]
            # Beyond 2 no distance lies.
            bound = 1 - np.minimum(bound, np.float32(2.1)) ** 2 / 2
            i, j = np.nonzero(dot >= bound)
            yield part[i], cols[j], np.sqrt(np.maximum(2 - 2 * dot[i, j], 0))


def traverse(a: Tree, b: Tree, xa: np.ndarray, xb: np.ndarray, threshold: float, links: Links, shift: int, base: int = 0) -> None:
    """Adds the links between two trees' points (in depth-first order; a's places from base on, b's from shift), or within one tree."""
    same = a is b
    limit = float(np.sqrt(max(2 - 2 * threshold, 0)))
    sa, sb = xa.astype(np.float32), xb.astype(np.float32)
    stack = [(np.array([0]), np.array([0]))]
    while stack:
        p, q = stack.pop()
        la, ea, ra = a.shape(p)
        lb, eb, rb = b.shape(q)
        for i, j, d in _near(sa, la, ra, sb, lb, rb, limit + _SLACK):
            if same:
                # Each pair of nodes once: of one tree, disjoint ones in order, and a node with itself.
                once = (lb[j] >= ea[i]) | (la[i] == lb[j]) & (ea[i] == eb[j])
                i, j, d = i[once], j[once], d[once]
            size = (ea[i] - la[i]) * (eb[j] - lb[j])
            own = same & (la[i] == lb[j]) & (ea[i] == eb[j])
            one = (size == 1) & ~own
            x, y = la[i[one]], lb[j[one]]
            linked = np.concatenate([np.einsum("ij,ij->i", xa[x[s : s + 65536]], xb[y[s : s + 65536]]) >= threshold for s in range(0, len(x), 65536)]) if len(x) else np.zeros(0, bool)
            links.pairs(x[linked] + base, y[linked] + shift)
            full = (size > 1) & (np.where(own, 2 * ra[i], d + ra[i] + rb[j]) <= limit - _SLACK)
            for u, v in zip(i[full].tolist(), j[full].tolist()):
                links.whole(int(la[u]) + base, int(ea[u]) + base, int(lb[v]) + shift, int(eb[v]) + shift)
            rest = np.flatnonzero((size > 1) & ~full)
            if not rest.size:
                continue
            i, j = i[rest], j[rest]
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            head = np.append(np.flatnonzero(np.append(True, i[1:] != i[:-1])), len(i))
            for s, e in zip(head[:-1], head[1:]):
                u = p[i[s : s + 1]]
                if same and e - s == 1 and la[i[s]] == lb[j[s]] and ea[i[s]] == eb[j[s]]:
                    kids = a.open(u)
                    stack.append((kids, kids))
                    continue
                alike = same & (lb[j[s:e]] == la[i[s]]) & (eb[j[s:e]] == ea[i[s]]) if same else np.zeros(e - s, bool)
                if alike.any():
                    kids = a.open(u)
                    stack.append((kids, kids))
                others = q[j[s:e][~alike]]
                if not len(others):
                    continue
                # Points stay as they are; larger nodes are opened on both sides.
                mine = u if ea[i[s]] - la[i[s]] == 1 else a.open(u)
                wide = eb[j[s:e][~alike]] - lb[j[s:e][~alike]] > 1
                theirs = np.concatenate([others[~wide], b.open(others[wide])]) if wide.any() else others
                stack.append((mine, theirs))


def _assign(pivots: np.ndarray):
    """The block of each vector's nearest pivot, and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vector"))
            step = max((1 << 22) // len(pivots), 1)
            for lo in range(0, len(x), step):
                d = _distances(x[lo : lo + step], pivots)
                home = d.argmin(axis=1)
                part = batch.slice(lo, len(d))
                yield pa.record_batch([*part.columns, pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(d)), home])], names=[*part.schema.names, "block", "away"])

    return run


def _grown(t: pa.Table) -> pa.Table:
    """A part in depth-first order, with the nodes that begin at each vector, outermost first."""
    t = t.sort_by("vec_id")
    tree = cover_tree(matrix(t["vector"]).astype(np.float32))
    n = np.bincount(tree.lo, minlength=len(t))
    t = t.take(pa.array(tree.order))
    place = pa.array(np.arange(len(t)), pa.int32())
    return pa.table({"part": t["part"], "place": place, "vec_id": t["vec_id"], "copies": t["copies"], "vector": t["vector"], "ends": list_array(tree.hi.astype(np.int32), n, pa.int32()), "radii": list_array(tree.radius, n, pa.float64())})


def _rooted(t: pa.Table) -> tuple[Tree, np.ndarray, np.ndarray, np.ndarray]:
    t = t.sort_by("place").combine_chunks()
    ends, radii = (t[c].combine_chunks() for c in ("ends", "radii"))
    n = ends.value_lengths().to_numpy(zero_copy_only=False)
    tree = Tree(np.arange(len(t)), np.repeat(np.arange(len(t)), n), ends.flatten().to_numpy().astype(np.int64), radii.flatten().to_numpy())
    return tree, matrix(t["vector"]), t["vec_id"].to_numpy(), t["copies"].to_numpy()


def _meet(threshold: float):
    """All pairs of parts of two groups, or of one: pairs too far apart end at their roots."""

    def run(t: pa.Table) -> pa.Table:
        low, high = t["low"][0].as_py(), t["high"][0].as_py()
        side, part = t["side"].to_numpy(), t["part"].to_numpy()
        parts, begin = [], 0
        for k in np.unique(part):
            mine = np.flatnonzero(part == k)
            tree, x, ids, weight = _rooted(t.take(pa.array(mine)))
            parts.append((side[mine[0]], tree, x, ids, weight, begin))
            begin += len(ids)
        ids, weight = (np.concatenate([p[k] for p in parts]) for k in (3, 4))
        links = Links(len(ids), weight)
        for k, (mine, a, xa, _, _, base) in enumerate(parts):
            if low == high:
                traverse(a, a, xa, xa, threshold, links, base, base)
            for other, b, xb, _, _, shift in parts[k + 1 :]:
                if low == high or mine != other:
                    traverse(a, b, xa, xb, threshold, links, shift, base)
        label, count = links.result()
        some = count > 0
        return pa.table({"vec_id": ids[some], "root": ids[label[some]], "links": count[some]})

    return run


def linked_embeddings(embeddings: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, class_id, n_links) of every vector.

    A link is another vector of at least the threshold cosine (above 0); n_links counts them all, copies included.
    class_id is the smallest vec_id that a chain of links leads to, the vector's own if it has none.

    Vectors of different lengths are never linked. Rows that unit_vectors() leaves out are left out; repeated vec_ids
    count as unit_vectors() says. Equal vectors under different vec_ids are folded to the smallest, which stands for
    them in the trees. Ties have no effect: a link counts or doesn't. An empty table gives no rows.
    """
    vectors = cut(unit_vectors(embeddings))
    folded = cut(vectors.groupBy("dim", "vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
    edges = None
    for dim in sorted(r["dim"] for r in folded.select("dim").distinct().collect()):
        mine = folded.where(F.col("dim") == dim).drop("dim")
        want = min(max(-(-mine.count() // block), 1), MOST_PIVOTS)
        chosen = mine.orderBy(F.xxhash64("vec_id"), "vec_id").limit(want).select("vector").collect()
        pivots = np.stack([np.frombuffer(bytes(r["vector"]), np.float64) for r in chosen])
        homes = cut(mine.mapInArrow(_assign(pivots), "vector binary, vec_id long, copies long, block int, away double"))
        # One row for a block, of which there are as many as pivots.
        sizes = homes.groupBy("block").agg(F.count("*").alias("n"), F.max("away").alias("radius")).orderBy("block").collect()
        at = np.array([r["block"] for r in sizes])
        radius = np.array([r["radius"] for r in sizes])
        parts = np.array([-(-r["n"] // block) for r in sizes])
        first = np.cumsum(parts) - parts
        limit = float(np.sqrt(max(2 - 2 * threshold, 0))) + _SLACK

        def partners(batches: Iterator[pa.RecordBatch], p=pivots[at].astype(np.float32), r=radius, parts=parts, first=first, limit=limit) -> Iterator[pa.RecordBatch]:
            """The parts that each part of a block meets: those of all blocks that hold something near enough."""
            for batch in batches:
                for k in batch.column("block").to_numpy():
                    near = np.flatnonzero(_distances(p[k : k + 1], p)[0] <= limit + r + r[k] + _SLACK)
                    others = (np.repeat(first[near], parts[near]) + ranges(parts[near])).astype(np.int32)
                    for part in range(first[k], first[k] + parts[k]):
                        yield pa.record_batch([pa.array([part], pa.int32()), list_array(others, np.array([len(others)]), pa.int32())], names=["part", "others"])

        spark = embeddings.sparkSession
        meets = spark.range(len(at)).select(F.col("id").cast("int").alias("block")).mapInArrow(partners, "part int, others array<int>")
        known = spark.createDataFrame([(int(a), int(n), int(f)) for a, n, f in zip(at, parts, first)], "block int, parts int, first int")
        placed = homes.join(known, "block").withColumn("part", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int"))
        grown = cut(placed.select("part", "vec_id", "copies", "vector").groupBy("part").applyInArrow(_grown, "part int, place int, vec_id long, copies long, vector binary, ends array<int>, radii array<double>"))
        # Parts travel in groups: a vector goes once to each group that its part meets, not to each part.
        wide = max(1, min(GROUP // block, -(-int(parts.sum()) // LEAST_GROUPS)))
        group = lambda c: (c / wide).cast("int")
        there = meets.select("part", F.array_distinct(F.transform("others", group)).alias("others"))
        both = grown.join(there, "part").withColumn("side", group(F.col("part"))).withColumn("other", F.explode("others")).drop("others")
        both = both.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other")).drop("other")
        found = both.groupBy("low", "high").applyInArrow(_meet(threshold), "vec_id long, root long, links long")
        edges = found if edges is None else edges.union(found)
    if edges is None:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, class_id long, n_links long")
    edges = cut(edges)
    roots = components(edges, "vec_id", "root").select(F.col("node").alias("rep"), F.col("root").alias("class_id"))
    counted = edges.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("links").alias("links"))
    reps = folded.select("dim", "vector", F.col("vec_id").alias("rep"), "copies").join(roots, "rep", "left").join(counted, "rep", "left")
    out = vectors.join(reps, ["dim", "vector"])
    return out.select("vec_id", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))


def op9_cover_tree_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for a vector: its class of near-duplicates and how many links it has."""
    return linked_embeddings(table(spark, sf_dir, "embeddings"))


#: Random vectors reach it too.
LOW_THRESHOLD = 0.4


def embedding_links_at_low_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at LOW_THRESHOLD, in small blocks: there are links in any of the tables."""
    return linked_embeddings(table(spark, sf_dir, "embeddings"), LOW_THRESHOLD, 256)


def oracle(threshold: float = THRESHOLD) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, MIN(CAST(embedding AS DOUBLE[])) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL GROUP BY vec_id),
p AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
r AS (SELECT vec_id, vec_id AS class_id FROM v UNION SELECT p.b, r.class_id FROM r JOIN p ON p.a = r.vec_id)
SELECT r.vec_id, MIN(r.class_id) AS class_id, (SELECT COUNT(*) FROM p WHERE p.a = r.vec_id)::BIGINT AS n_links FROM r GROUP BY r.vec_id"""
