"""Near-duplicate vectors by dual traversal of cover trees.

The upper levels of the trees are DataFrames: the vectors of a label are split around pivots, each going to its nearest one, the
parts around pivots of their own, and so on down to blocks of bounded size. Every node knows its centre and the radius that
really covers its vectors. The tree of a label is walked against itself, level by level: pairs of nodes farther apart than the
threshold plus both radii are dropped before any vector of theirs is fetched, pairs surely closer count whole, and the others
are replaced by the pairs of their children. Only block pairs that are left meet with their data. Inside a block a cover tree
in numpy, of nested levels with halving radii, goes on in the same way down to exact products of small groups. Tasks return link
counts and a spanning forest, never all pairs.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import components, lookup, table

MARGIN, SLACK = 1e-9, 1e-6
#: Distances under some 1e-8 are noise: a node of this radius is not split by them.
TIGHT = 1e-6


class CoverTree:
    """points: unit vectors, reordered so that each node's lie together. Node arrays: center, radius, begin, end, children."""

    def __init__(self, points: np.ndarray, leaf: int = 32):
        self.order = np.arange(len(points))
        self.points, self.leaf = points, leaf
        self.center, self.radius, self.begin, self.end, self.children = [], [], [], [], []
        if len(points):
            self._node(0, len(points), 2.0)
        self.center, self.radius = np.array(self.center, np.int64), np.array(self.radius)
        self.begin, self.end = np.array(self.begin, np.int64), np.array(self.end, np.int64)
        self.points = points[self.order]

    def _node(self, begin: int, end: int, cover: float) -> int:
        """A node over order[begin:end], whose first point is its centre; children cover it with half the radius."""
        me = len(self.center)
        mine = self.order[begin:end]
        d = distances(self.points[mine[:1]], self.points[mine])[0]
        self.center.append(begin)
        self.radius.append(float(d.max()) + MARGIN if end - begin > 1 else 0.0)
        self.begin.append(begin)
        self.end.append(end)
        self.children.append([])
        if end - begin <= self.leaf or self.radius[me] <= TIGHT:
            return me
        half = cover / 2
        while half > self.radius[me]:
            half /= 2
        rest, groups = np.arange(len(mine)), []
        near = d
        while True:  # the node's own centre goes on as the first child's; others are taken from what it leaves uncovered
            inside = near <= half
            groups.append(rest[inside])
            rest = rest[~inside]
            if not len(rest):
                break
            near = distances(self.points[mine[rest[:1]]], self.points[mine[rest]])[0]
            near[0] = 0.0
        at = begin
        spans = []
        for g in groups:
            spans.append((at, at + len(g)))
            at += len(g)
        self.order[begin:end] = mine[np.concatenate(groups)]
        self.children[me] = np.array([self._node(a, b, half) for a, b in spans])
        return me


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


class Links:
    """What a dual traversal finds: the weight of each point's partners, and links enough to connect whatever is linked."""

    def __init__(self, a: CoverTree, b: CoverTree, wa: np.ndarray, wb: np.ndarray, cosine: float, same: bool):
        self.a, self.b, self.cosine, self.same = a, b, cosine, same
        self.wa, self.wb = wa, wb
        self.na, self.nb = np.zeros(len(wa), np.int64), np.zeros(len(wb), np.int64)
        self.edges: list[np.ndarray] = []
        limit = np.sqrt(2 - 2 * cosine)
        if len(wa) and len(wb):
            self._walk(limit)

    def _walk(self, limit: float) -> None:
        a, b, todo = self.a, self.b, [(0, 0)]
        while todo:
            p, q = todo.pop()
            if (a.end[p] - a.begin[p]) * (b.end[q] - b.begin[q]) <= 4096 or not (len(a.children[p]) or len(b.children[q])):
                self._points(p, q)
                continue
            ps = a.children[p] if len(a.children[p]) else np.array([p])
            qs = b.children[q] if len(b.children[q]) else np.array([q])
            d = distances(a.points[a.center[ps]], b.points[b.center[qs]])
            reach = a.radius[ps][:, None] + b.radius[qs][None, :]
            inside = d + reach <= limit - SLACK
            open_ = (d - reach <= limit + SLACK) & ~inside
            if self.same and p == q:
                open_ = np.triu(open_) | np.eye(len(ps), dtype=bool)
                inside = np.triu(inside, 1)
            for i, j in zip(*np.nonzero(inside)):
                self._whole(ps[i], qs[j])
            small = (a.end[ps] - a.begin[ps])[:, None] * (b.end[qs] - b.begin[qs])[None, :] <= 4096
            for i, j in zip(*np.nonzero(open_ & small)):
                self._points(ps[i], qs[j])
            todo += [(ps[i], qs[j]) for i, j in zip(*np.nonzero(open_ & ~small))]

    def _whole(self, p: int, q: int) -> None:
        a, b = self.a, self.b
        i, j = np.arange(a.begin[p], a.end[p]), np.arange(b.begin[q], b.end[q])
        self.na[i] += self.wb[j].sum()
        self.nb[j] += self.wa[i].sum()
        self.edges += [np.column_stack([i, np.full(len(i), j[0])]), np.column_stack([np.full(len(j), i[0]), j])]

    def _points(self, p: int, q: int) -> None:
        a, b = self.a, self.b
        i0, j0 = a.begin[p], b.begin[q]
        hit = a.points[i0 : a.end[p]] @ b.points[j0 : b.end[q]].T >= self.cosine
        if self.same and p == q:
            hit = np.triu(hit, 1)
        if not hit.any():
            return
        self.na[i0 : a.end[p]] += hit @ self.wb[j0 : b.end[q]]
        self.nb[j0 : b.end[q]] += self.wa[i0 : a.end[p]] @ hit
        self.edges.append(forest(np.argwhere(hit) + (i0, j0), self.same))


def forest(pairs: np.ndarray, same: bool) -> np.ndarray:
    """Of the pairs those that connect what all of them connect; the two sides are apart unless same."""
    if len(pairs) < 3:
        return pairs
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for k, (i, j) in enumerate(pairs.tolist()):
        x, y = find(i), find(j if same else ~j)
        if x != y:
            parent[x] = y
            keep.append(k)
    return pairs[keep]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that neither tiny nor huge components are lost in their squares."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _units(batches):
    """Column 0, arrays of numbers, as bytes of unit vectors."""
    for b in batches:
        data = [unit(np.array(x, float)[None]).tobytes() for x in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), *b.columns[1:]], names=["data", *b.schema.names[1:]])


def _nearest(batches):
    """Rows sorted by node and share, a share's pivots (kind 0) first: each member with the slot of its nearest pivot and the distance."""
    share, pivots, slots, stacked = None, [], [], None
    for b in batches:
        node, part, kind, slot = (np.asarray(b.column(k)) for k in range(4))
        first = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])))
        for i, j in zip(first, np.append(first[1:], len(node))):
            data = np.stack([np.frombuffer(x) for x in b.column(6).slice(i, j - i).to_pylist()])
            if (node[i], part[i]) != share:
                share, pivots, slots = (node[i], part[i]), [], []
            if kind[i] == 0:
                pivots.append(data)
                slots.append(slot[i:j])
                stacked = np.concatenate(pivots), np.concatenate(slots)
                continue
            d = distances(data, stacked[0])
            best = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [b.column(4).slice(i, j - i), b.column(5).slice(i, j - i), b.column(6).slice(i, j - i), pa.array(node[i:j]), pa.array(stacked[1][best]), pa.array(d[np.arange(len(best)), best])],
                names=["c", "weight", "data", "parent", "slot", "far"],
            )


def _split(here: DataFrame, big: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """The members of the nodes in big (node, slots, shares, tight) with their new nodes, and these nodes; one level of the tree.

    A node's pivots are, for each slot, the member with the smallest hash; they are copied to the node's shares, so that the
    members of a large node are dealt over many tasks. In a tight node, or one that comes from such, all vectors lie within twice
    TIGHT of each other; its members go to slots by hash.
    """
    inner = lookup(here, big, "node").where("slots is not null")
    pick = F.struct(F.xxhash64(F.lit(level + 100), "c"), "c")
    pivots = inner.groupBy("node", F.pmod(F.xxhash64(F.lit(level), "c"), F.col("slots")).alias("slot")).agg(F.min_by("data", pick).alias("data"), F.max("shares").alias("shares"), F.bool_or("tight").alias("tight"))
    pivots = table(pivots, "pivots")
    none = F.lit(None).cast("long")
    heads = pivots.where("not tight").select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"), "slot", none.alias("c"), none.alias("weight"), "data")
    rest = inner.where("not tight").select("node", F.pmod(F.xxhash64(F.lit(level + 200), "c"), F.col("shares")).alias("share"), F.lit(1).alias("kind"), F.lit(-1).cast("long").alias("slot"), "c", "weight", "data")
    dealt = heads.union(rest).repartition("node", "share").sortWithinPartitions("node", "share", "kind", "slot")
    placed = dealt.mapInArrow(_nearest, "c long, weight long, data binary, parent long, slot long, far double")
    slot = F.pmod(F.xxhash64(F.lit(level), "c"), F.col("slots"))
    spread = inner.where("tight").select("c", "weight", "data", F.col("node").alias("parent"), slot.alias("slot"), F.lit(2 * TIGHT).alias("far"), F.lit(True).alias("tight"))
    placed = placed.withColumn("tight", F.lit(False)).unionByName(spread)
    placed = table(placed.withColumn("node", F.xxhash64(F.lit(level), "parent", "slot")), "placed")
    nodes = placed.groupBy("node", "parent", "slot").agg(F.count("*").alias("size"), (F.max("far") + MARGIN).alias("radius"), F.sum("weight").alias("weight"), F.bool_or("tight").alias("tight"))
    nodes = nodes.withColumn("tight", F.col("tight") | (F.col("radius") <= TIGHT)).join(pivots.select(F.col("node").alias("parent"), "slot", F.col("data").alias("center")), ["parent", "slot"])
    return placed.select("c", "weight", "data", "node"), table(nodes.withColumn("tile", F.xxhash64("parent", F.shiftright("slot", 3))), "nodes")


def _tree(points: DataFrame, block: int, fan: int, share: int):
    """Nodes (node, parent, size, radius, weight, center, tile, leaf), the leaves' members (node, tile, c, weight, data), and (c, node) of all levels but the root's."""
    here = table(points.select("c", "weight", "data", F.col("root").alias("node")), "placed")
    sizes = here.groupBy("node").agg(F.count("*").alias("size"), F.sum("weight").alias("weight"))
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("parent", "long"), ("slot", "long"), ("radius", "double"), ("center", "binary"))] + [F.lit(False).alias("tight")]
    nodes, level, found, leaves, members = table(sizes.select("*", *empty, F.col("node").alias("tile")), "nodes"), 0, [], [], []
    while True:
        size = F.col("size")
        big = nodes.where(size > block).select("node", F.least(F.lit(fan), F.ceil(4 * size / block)).cast("long").alias("slots"), F.ceil(size / share).cast("long").alias("shares"), "tight")
        found.append(nodes.withColumn("leaf", size <= block).drop("slot", "tight"))
        leaves.append(lookup(here, nodes.where(size <= block).select("node", "tile"), "node").where("tile is not null").select("node", "tile", "c", "weight", "data"))
        if not big.limit(1).count():
            break
        here, nodes = _split(here, big, level)
        members.append(here.select("c", "node"))
        level += 1
    union = lambda parts, none: parts[0].unionByName(union(parts[1:], none)) if len(parts) > 1 else (parts or [none])[0]
    return table(union(found, None), "nodes"), union(leaves, None), union(members, here.select("c", "node").limit(0))


PAIR = "p long, q long, leaf_p boolean, leaf_q boolean, tile_p long, tile_q long, weight_p long, weight_q long, whole boolean"


def _met(pairs: DataFrame, payload: DataFrame, fn, schema: str) -> DataFrame:
    """fn over groups of pairs (p, q) together with the payload (node, blob) of their nodes.

    Nodes lie in tiles of at most eight; the pairs of two tiles are one group, so each blob is sent once for up to eight partners.
    """
    group = F.xxhash64("tile_p", "tile_q").alias("group")
    pairs = pairs.select(group, "p", "q", "tile_p", "tile_q")
    need = pairs.select("group", F.col("p").alias("node")).union(pairs.select("group", F.col("q").alias("node"))).distinct().join(payload, "node")
    need = need.select(F.col("group").alias("sent_to"), "node", "blob")
    return pairs.groupBy("group").cogroup(need.groupBy("sent_to")).applyInPandas(fn, schema)


def _expanded(limit: float):
    """Pairs of nodes to the pairs of their children that may hold links."""

    def run(pairs: pd.DataFrame, need: pd.DataFrame) -> pd.DataFrame:
        kids = {n: pickle.loads(b) for n, b in zip(need.node, need.blob)}
        out = []
        for p, q in zip(pairs.p, pairs.q):
            a, b = kids[p], kids[q]
            d = distances(a["center"], b["center"])
            reach = a["radius"][:, None] + b["radius"]
            if p == q:  # a node against itself: closed if no two of its vectors can be farther apart than the limit
                d[np.arange(len(d)), np.arange(len(d))] = 0.0
            whole = d + reach <= limit - SLACK
            meet = d - reach <= limit + SLACK
            if p == q:
                meet = np.triu(meet)
            i, j = np.nonzero(meet)
            out.append(pd.DataFrame({**{f"{c}_{s}" if c != "node" else s: x[c][k] for s, x, k in (("p", a, i), ("q", b, j)) for c in ("node", "leaf", "tile", "weight")}, "whole": whole[i, j]}))
        return pd.concat(out)[[c.split()[0] for c in PAIR.split(", ")]] if out else pd.DataFrame(columns=[c.split()[0] for c in PAIR.split(", ")])

    return run


def _walked(cosine: float):
    """Pairs of blocks to link counts (a, a, n) and connecting links (a, b, 0)."""

    def run(pairs: pd.DataFrame, need: pd.DataFrame) -> pd.DataFrame:
        blocks = {n: pickle.loads(b) for n, b in zip(need.node, need.blob)}
        out = [pd.DataFrame({"a": [], "b": [], "n": []}, dtype=np.int64)]
        for p, q in zip(pairs.p, pairs.q):
            (a, o1, w1), (b, o2, w2) = blocks[p], blocks[q]
            same = p == q
            got = Links(a, b, w1, w2, cosine, same)
            for o, n in ((o1, got.na + got.nb),) if same else ((o1, got.na), (o2, got.nb)):
                out.append(pd.DataFrame({"a": o, "b": o, "n": n})[n > 0])
            if got.edges:
                e = forest(np.concatenate(got.edges), same)
                out.append(pd.DataFrame({"a": o1[e[:, 0]], "b": o2[e[:, 1]], "n": 0}))
        return pd.concat(out)

    return run


def _packed_kids(group: pd.DataFrame) -> pd.DataFrame:
    kids = {c: group[c].to_numpy() for c in ("node", "leaf", "tile", "weight", "radius")} | {"center": np.stack([np.frombuffer(x) for x in group.center])}
    return pd.DataFrame({"node": group.parent[:1], "blob": [pickle.dumps(kids)]})


def _packed_block(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("c")
    tree = CoverTree(np.stack([np.frombuffer(x) for x in group.data]))
    return pd.DataFrame({"node": group.node[:1], "blob": [pickle.dumps((tree, group.c.to_numpy(np.int64)[tree.order], group.weight.to_numpy(np.int64)[tree.order]))]})


def _links(points: DataFrame, cosine: float, block: int, fan: int, share: int) -> tuple[DataFrame, DataFrame]:
    """Of distinct points (c, weight, data, root): the weight linked to each (c, links), and edges (a, b) that connect the linked ones."""
    nodes, leaves, members = _tree(points, block, fan, share)
    child = nodes.where("center is not null")
    own = child.where("leaf").withColumn("parent", F.col("node"))  # a leaf met by an inner node stands for itself
    kids = table(child.unionByName(own).groupBy("parent").applyInPandas(_packed_kids, "node long, blob binary"), "kids")
    blocks = table(leaves.groupBy("node").applyInPandas(_packed_block, "node long, blob binary"), "blocks")
    root = nodes.where("center is null")
    pairs = root.select(*[F.col(c).alias(f"{c}_{s}" if c != "node" else s) for s in "pq" for c in ("node", "leaf", "tile", "weight")], F.lit(False).alias("whole"))
    pairs, done = table(pairs, "pairs"), []
    while True:
        final = F.col("whole") | (F.col("leaf_p") & F.col("leaf_q"))
        done.append(pairs.where(final))
        if not pairs.where(~final).limit(1).count():
            break
        pairs = table(_met(pairs.where(~final), kids, _expanded(np.sqrt(2 - 2 * cosine)), PAIR), "pairs")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    walked = table(_met(found.where("not whole"), blocks, _walked(cosine), "a long, b long, n long"), "links")
    whole = found.where("whole")
    gains = whole.where("p <> q").select(F.col("p").alias("node"), F.col("weight_q").alias("gain"), F.lit(0).alias("own"))
    gains = gains.union(whole.select(F.col("q").alias("node"), F.col("weight_p").alias("gain"), (F.col("p") == F.col("q")).cast("int").alias("own")))
    gains = table(gains.groupBy("node").agg(F.sum("gain").alias("gain"), F.max("own").alias("own")), "gains")
    inside = table(lookup(members, gains, "node").where("gain is not null").join(points.select("c", "weight"), "c"), "inside")
    counts = walked.where("n > 0").select(F.col("a").alias("c"), "n").union(inside.select("c", F.col("gain") - F.col("own") * F.col("weight")))
    edges = walked.where("n = 0").select("a", "b").union(inside.select("c", "node")).union(whole.where("p <> q").select("p", "q"))
    return counts.groupBy("c").agg(F.sum("n").alias("links")), edges


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, cosine: float = 0.98, block: int = 1024, fan: int = 64, share: int = 20_000) -> DataFrame:
    """One row for each row of vectors: id_col, n_links, component_id, kept.

    Rows with equal, non-null labels link when the cosine of their vectors, in double precision, reaches the threshold. n_links
    counts the other rows linked directly, component_id is the smallest id reachable, kept tells whether that is the row's own.
    Vectors that are null, zero or hold null or non-finite components, and rows with a null label, link with nothing. Rows of
    equal label and vector are one class whose smallest id stands for it; vectors of different lengths never link. A null id
    counts as a partner, but its own component is null and it is not kept. Vectors and nodes are told apart by 64-bit hashes.

    block: largest number of vectors compared as one block. fan: pivots of a node. share: vectors of a node that one task deals.
    """
    x = F.col(vector_col).cast("array<double>")
    good = F.col("x").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("x")).withColumn("good", F.coalesce(good, F.lit(False)))
    key = F.sha2(F.concat_ws(",", F.transform("x", lambda v: F.hex(F.when(v == 0, 0.0).otherwise(v).cast("string")))), 256)
    rows = table(rows.withColumn("key", F.when(F.col("good"), F.concat_ws("|", F.col("label").cast("string"), key))), "vectors")
    sole = rows.where("good").groupBy("key").agg(F.first("x").alias("x"), F.first("label").alias("label"), F.min("id").alias("own"), F.count("*").alias("weight"))
    sole = sole.select("x", F.xxhash64("key").alias("c"), F.xxhash64(F.col("label").cast("string"), F.size("x")).alias("root"), "own", "weight", "key")
    sole = table(sole.mapInArrow(_units, "data binary, c long, root long, own long, weight long, key string"), "classes")
    links, edges = _links(sole, cosine, block, fan, share)
    comp = components(edges)
    named = sole.select("c", "key", "own", "weight").join(comp.select(F.col("v").alias("c"), "component"), "c", "left")
    named = table(named.withColumn("component", F.coalesce("component", "c")).join(links, "c", "left"), "named")
    least = table(named.groupBy("component").agg(F.min("own").alias("least")), "least")
    named = lookup(named, least, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "least")
    out = lookup(rows.where("good").select("id", "key"), table(named, "named"), "key").select("id", "links", "least")
    out = out.union(rows.where("not good").select("id", F.lit(0).cast("long"), "id")).select(
        F.col("id").alias(id_col), F.col("links").cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).cast("long").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
