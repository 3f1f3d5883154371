"""Embedding near-dedup over robust-pruned flat graphs.

Vectors link when their labels are equal and not null and their cosine, in double
precision, is at least `threshold`. Equal vectors of a label become one node with a number
of copies. A label of more than `CELL_MAX` nodes is cut into cells around sampled pivots,
every node going to its nearest pivot and, as a guest, to every pivot whose cell lies
within the threshold's angle. A cell's own nodes are compared with all its nodes in tiles
of bounded size, so every pair at the threshold meets and no link depends on a search.

The nodes of a smaller label are one cell, in which overlapping k-means shards are linked by robust pruning
(a candidate is dropped when a chosen neighbour is `ALPHA` times nearer to it) and the
shards' adjacency lists are united into one flat graph. Every node of the cell then
searches it greedily with a beam from the shard medoids and its own place and expands the range: nodes
within reach are followed until none is new. Recall is audited in every cell against
brute force for the nodes whose hash is divisible by 50; while it is below `AUDIT`, the
search is repeated with a wider beam and reach. Links are verified, so none lies below
the threshold.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and
null labels, link with nothing; vectors of unequal length do not link; a row with a null id
takes part but is nobody's class id; repeated rows count as separate vectors; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnweave.llm.components import components
from turnweave.llm.storage import Workspace

THRESHOLD = 0.98
CELL_MAX = 8192
TILE = 8192
MAX_PIVOTS = 65536
SHARD, SHARD_MAX, OVERLAP = 512, 2048, 2
DEGREE, NEAREST, CANDIDATES, ALPHA = 24, 8, 96, 1.44  # of 1 - cosine: 1.2 of the distance
BEAM, SLACK, AUDIT = 32, 0.02, 0.995
BLOCK = 512


# --- One cell ----------------------------------------------------------------------------


def _shards(x: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Overlapping clusters: every vector is in its `OVERLAP` nearest; large ones are cut at random."""
    n = len(x)
    k = -(-n // SHARD)
    if k == 1:
        return [np.arange(n)]
    centre = x[rng.choice(n, k, replace=False)]
    for _ in range(4):
        own = np.concatenate([(x[i : i + 4096] @ centre.T).argmax(axis=1) for i in range(0, n, 4096)])
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 0, total / np.maximum(norm, 1e-300), centre)
    take = min(OVERLAP, k)
    near = np.concatenate([np.argpartition(-(x[i : i + 4096] @ centre.T), take - 1, axis=1)[:, :take] for i in range(0, n, 4096)])
    out = []
    for c in range(k):
        members = rng.permutation(np.flatnonzero((near == c).any(axis=1)))
        pieces = max(1, -(-len(members) // SHARD_MAX))
        out += [np.sort(p) for p in np.array_split(members, pieces) if len(p)]
    return out


def _robust_prune(sim: np.ndarray) -> np.ndarray:
    """(n, DEGREE) neighbours within a shard by robust pruning of the nearest candidates; -1 pads."""
    n = len(sim)
    c = min(CANDIDATES, n - 1)
    out = np.full((n, DEGREE), -1)
    if c < 1:
        return out
    near = sim.copy()
    np.fill_diagonal(near, -np.inf)
    cand = np.argpartition(-near, c - 1, axis=1)[:, :c]
    rows = np.arange(n)
    cand = np.take_along_axis(cand, np.argsort(-near[rows[:, None], cand], axis=1, kind="stable"), axis=1)
    far = 1 - near[rows[:, None], cand]
    open_ = np.ones((n, c), bool)
    kept = min(NEAREST, c)  # the nearest stay unpruned, or dense groups would fall into islands
    out[:, :kept] = cand[:, :kept]
    open_[:, :kept] = False
    for k in range(kept):
        open_ &= ALPHA * (1 - sim[cand[:, k, None], cand]) > far
    for r in range(kept, DEGREE):
        some = open_.any(axis=1)
        if not some.any():
            break
        at = open_.argmax(axis=1)
        chosen = cand[rows, at]
        out[some, r] = chosen[some]
        between = 1 - sim[chosen[:, None], cand]
        open_ &= ~((ALPHA * between <= far) & some[:, None])
        open_[rows[some], at[some]] = False
    return out


def build_graph(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(adjacency padded with -1, entry nodes): the union of the shards' lists, both directions, and the shards' medoids."""
    n, sources, targets, medoids = len(x), [], [], []
    for members in _shards(x, rng):
        v = x[members]
        sim = v @ v.T
        near = _robust_prune(sim)
        a, r = np.nonzero(near >= 0)
        sources.append(members[a]), targets.append(members[near[a, r]])
        medoids.append(members[(v @ v.mean(axis=0)).argmax()])
    random = rng.integers(0, n, 2 * n)  # a few far links keep the graph connected
    sources.append(np.repeat(np.arange(n), 2)), targets.append(random)
    s, t = np.concatenate(sources), np.concatenate(targets)
    keys = np.unique(np.concatenate([s * n + t, t * n + s]))
    s, t = keys // n, keys % n
    s, t = s[s != t], t[s != t]
    degree = np.bincount(s, minlength=n)
    adjacency = np.full((n, max(1, degree.max(initial=1))), -1)
    adjacency[s, np.arange(len(s)) - np.repeat(np.concatenate([[0], np.cumsum(degree)])[:-1], degree)] = t
    # very large in-degrees are cut to the nearest, so that a step stays small
    if adjacency.shape[1] > 4 * DEGREE:
        wide = np.flatnonzero(degree > 4 * DEGREE)
        for i in wide:
            own = adjacency[i, : degree[i]]
            best = own[np.argsort(-(x[own] @ x[i]), kind="stable")]
            adjacency[i] = -1
            adjacency[i, : 4 * DEGREE] = np.concatenate([best[: 3 * DEGREE], best[-DEGREE:]])
        adjacency = adjacency[:, : 4 * DEGREE]
    return adjacency, np.unique(medoids)


def range_search(x: np.ndarray, adjacency: np.ndarray, entries: np.ndarray, queries: np.ndarray, threshold: float, beam: int, slack: float) -> np.ndarray:
    """(queries, nodes) matrix of nodes found at `threshold` or above: greedy beam, then range expansion."""
    q, n = len(queries), len(x)
    v = x[queries]
    seen = np.zeros((q, n), bool)
    rows = np.arange(q)
    start = min(beam - 1, len(entries), 8)
    sims = v @ x[entries].T
    best = np.argsort(-sims, axis=1)[:, :start]
    ids = np.full((q, beam), -1)
    val = np.full((q, beam), -np.inf)
    ids[:, :start], val[:, :start] = entries[best], np.take_along_axis(sims, best, axis=1)
    own = (ids[:, :start] != queries[:, None]).all(axis=1)  # the query's own node is an entry besides the medoids
    ids[own, start], val[own, start] = queries[own], 1.0
    start += 1
    done = ids < 0
    seen[np.repeat(rows, start)[ids[:, :start].ravel() >= 0], ids[:, :start].ravel()[ids[:, :start].ravel() >= 0]] = True
    close_q, close_n = [], []  # everything met within reach, also what leaves the beam
    reach = threshold - slack

    def meet(qi: np.ndarray, ni: np.ndarray, s: np.ndarray) -> None:
        near = s >= reach
        close_q.append(qi[near]), close_n.append(ni[near])

    meet(np.repeat(rows, start), ids[:, :start].ravel(), val[:, :start].ravel())
    live = rows
    while len(live):
        at = np.where(done[live], -np.inf, val[live]).argmax(axis=1)
        more = ~done[live, at]
        live, at = live[more], at[more]
        if not len(live):
            break
        done[live, at] = True
        nb = adjacency[ids[live, at]]
        new = (nb >= 0) & ~seen[live[:, None], nb]
        s = np.full(nb.shape, -np.inf)
        r, c = np.nonzero(new)
        qi, ni = live[r], nb[r, c]
        s[r, c] = np.einsum("ij,ij->i", v[qi], x[ni])
        seen[qi, ni] = True
        meet(qi, ni, s[r, c])
        all_ids, all_val = np.concatenate([ids[live], nb], axis=1), np.concatenate([val[live], s], axis=1)
        all_done = np.concatenate([done[live], ~new], axis=1)
        top = np.argpartition(-all_val, beam - 1, axis=1)[:, :beam]
        ids[live], val[live], done[live] = (np.take_along_axis(z, top, axis=1) for z in (all_ids, all_val, all_done))
    found = np.zeros((q, n), bool)
    fq, fn = np.concatenate(close_q), np.concatenate(close_n)
    while len(fq):
        s = np.einsum("ij,ij->i", v[fq], x[fn])
        hit = s >= threshold
        found[fq[hit], fn[hit]] = True
        nb = adjacency[fn]
        r, c = np.nonzero((nb >= 0) & ~seen[fq[:, None], nb])
        fresh = np.zeros((q, n), bool)
        fresh[fq[r], nb[r, c]] = True
        fq, fn = np.nonzero(fresh)
        seen |= fresh
        near = np.einsum("ij,ij->i", v[fq], x[fn]) >= reach if len(fq) else np.zeros(0, bool)
        fq, fn = fq[near], fn[near]
    found[rows, queries] = False
    return found


def cell_links(x: np.ndarray, audited: np.ndarray, threshold: float = THRESHOLD) -> tuple[list[np.ndarray], float]:
    """(neighbours of each vector, audited recall). Lists are symmetric."""
    n = len(x)
    if n == 1:
        return [np.zeros(0, int)], 1.0
    rng = np.random.default_rng(20240607)
    adjacency, entries = build_graph(x, rng)
    truth = x[audited] @ x.T >= threshold if len(audited) else np.zeros((0, n), bool)
    if len(audited):
        truth[np.arange(len(audited)), audited] = False
    beam, slack, recall = min(BEAM, max(2, n)), SLACK, 1.0
    for _ in range(4):
        if not truth.any():
            break
        got = range_search(x, adjacency, entries, audited, threshold, beam, slack)
        recall = float((got & truth).sum() / truth.sum())
        if recall >= AUDIT:
            break
        beam, slack = min(2 * beam, n), 2 * slack
    held = np.zeros((n, (n + 7) // 8), np.uint8)
    for i in range(0, n, BLOCK):
        queries = np.arange(i, min(i + BLOCK, n))
        held[queries] = np.packbits(range_search(x, adjacency, entries, queries, threshold, beam, slack), axis=1)
    out: list[np.ndarray] = []
    for i in range(0, n, BLOCK):
        stop = min(i + BLOCK, n)
        own = np.unpackbits(held[i:stop], axis=1, count=n).astype(bool)
        other = np.unpackbits(held[:, i // 8 : (stop + 7) // 8], axis=1)[:, : stop - i].astype(bool).T
        both = own | other
        out += [np.flatnonzero(row) for row in both]
    return out, recall


def _roots(lists: list[np.ndarray]) -> np.ndarray:
    """Smallest index reachable in a cell."""
    parent = np.arange(len(lists))
    a = np.concatenate([np.full(len(l), i) for i, l in enumerate(lists)]) if lists else np.zeros(0, int)
    b = np.concatenate(lists) if lists else np.zeros(0, int)
    while True:
        before = parent.copy()
        np.minimum.at(parent, a, parent[b])
        parent = parent[parent]
        if (parent == before).all():
            return parent


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _cell(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    pdf = pdf.sort_values("node", kind="stable").drop_duplicates("node")
    x = _unit(np.stack(pdf["vector"].to_numpy()))
    node, copies = pdf["node"].to_numpy(), pdf["copies"].to_numpy()
    lists, recall = cell_links(x, np.flatnonzero(node % 50 == 0), threshold)
    links = np.array([copies[l].sum() for l in lists])
    root = _roots(lists)
    return pd.DataFrame({"node": node, "own": pdf["own"].to_numpy(), "n_links": links + copies - 1, "root": node[root], "recall": recall})


# --- All cells ---------------------------------------------------------------------------


def _valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _placed(nodes: DataFrame, cell_max: int, threshold: float) -> DataFrame:
    """(node, label, dim, cell, own) of large labels: each node's nearest pivot, and as a guest every cell that a vector within reach may own.

    A vector z of pivot p's cell has z.(p - q) >= 0 for the pivot q nearest to x. If the angle
    of x and z is at most arccos(threshold), x.(q - p) <= sin(arccos(threshold)) |q - p|.
    """
    spark = nodes.sparkSession
    pivots = {}
    picked = nodes.where(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(max(1, cell_max // 2))) == 0)
    for r in picked.select("label", "dim", "vector").orderBy(F.xxhash64("vector")).limit(MAX_PIVOTS).collect():  # bounded sample
        pivots.setdefault((r["label"], r["dim"]), []).append(r["vector"])
    shared = spark.sparkContext.broadcast({k: _unit(np.array(v, np.float64)) for k, v in pivots.items()})
    slant = np.sqrt(max(0.0, 1 - threshold**2)) if threshold > 0 else np.inf

    def run(batches):
        for pdf in batches:
            for (label, dim), group in pdf.groupby(["label", "dim"], sort=False):
                m = shared.value.get((label, dim))
                step = len(group) if m is None else max(1, (1 << 21) // len(m))
                for i in range(0, len(group), step):
                    part = group.iloc[i : i + step]
                    if m is None:
                        yield part[["node", "label", "dim"]].assign(cell=0, own=True)
                        continue
                    sim = _unit(np.stack(part["vector"].to_numpy())) @ m.T
                    own = sim.argmax(axis=1)
                    rows = np.arange(len(own))
                    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (m[own] @ m.T)))
                    within = sim[rows, own][:, None] - sim <= slant * apart + 1e-7
                    within[rows, own] = True
                    r, c = np.nonzero(within)
                    yield part[["node", "label", "dim"]].iloc[r].assign(cell=c, own=c == own[r])

    fields = [f for f in nodes.schema.fields if f.name in ("node", "label", "dim")]
    fields = sorted(fields, key=lambda f: ("node", "label", "dim").index(f.name))
    added = [T.StructField("cell", T.IntegerType()), T.StructField("own", T.BooleanType())]
    return nodes.select("node", "label", "dim", "vector").mapInPandas(run, T.StructType([*fields, *added]))


def _tile(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of a tile's left nodes to its right nodes, and every node's root over them, by brute force."""
    pdf = pdf.drop_duplicates(["node", "left"])
    node, at = np.unique(pdf["node"].to_numpy(), return_inverse=True)
    x, is_left = _unit(np.stack(pdf["vector"].to_numpy())), pdf["left"].to_numpy()
    left, right, a_at, b_at = x[is_left], x[~is_left], at[is_left], at[~is_left]
    copies = pdf["copies"].to_numpy()[~is_left]
    links, root, every = np.zeros(len(left), np.int64), np.arange(len(node)), np.arange(len(node))
    for i in range(0, len(left), BLOCK):
        hit = left[i : i + BLOCK] @ right.T >= threshold
        hit &= a_at[i : i + BLOCK, None] != b_at
        links[i : i + BLOCK] = [copies[row].sum() for row in hit]
        r, c = np.nonzero(hit)
        a, b = np.concatenate([a_at[i + r], every]), np.concatenate([b_at[c], root])
        while len(r):
            before = root.copy()
            np.minimum.at(root, a, before[b])
            np.minimum.at(root, b, before[a])
            root = root[root]
            if (root == before).all():
                break
    own = pd.DataFrame({"node": node[a_at], "own": True, "n_links": links, "root": node[root[a_at]], "recall": 1.0})
    met = np.flatnonzero(root != every)
    met = met[~np.isin(met, a_at)]
    return pd.concat([own, pd.DataFrame({"node": node[met], "own": False, "n_links": 0, "root": node[root[met]], "recall": 1.0})])


def _tiled(nodes: DataFrame, cell_max: int, threshold: float, tile: int, space: Workspace) -> DataFrame:
    """The results of `_tile` for all large labels; a cell's own nodes and all its nodes are dealt to tiles of about `tile` x `tile`."""
    cell = ["label", "dim", "cell"]
    placed = space.table(_placed(nodes, cell_max, threshold), "cells")
    parts = lambda n: F.ceil(n / F.lit(tile)).cast("int")
    sizes = placed.groupBy(*cell).agg(parts(F.count_if("own")).alias("parts_a"), parts(F.count("*")).alias("parts_b")).where("parts_a > 0")
    dealt = placed.join(space.table(sizes, "tiles"), cell)
    a, b = (F.pmod(F.xxhash64("node", F.lit(k)), F.col(f"parts_{k}")).cast("int") for k in "ab")
    all_of = lambda k: F.explode(F.sequence(F.lit(0), F.col(f"parts_{k}") - 1))
    left = dealt.where("own").select("node", *cell, a.alias("a"), all_of("b").alias("b"), F.lit(True).alias("left"))
    right = dealt.select("node", *cell, all_of("a").alias("a"), b.alias("b"), F.lit(False).alias("left"))
    rows = left.unionByName(right).join(nodes.select("node", "vector", "copies"), "node")
    schema = "node long, own boolean, n_links long, root long, recall double"
    found = space.table(rows.groupBy(*cell, "a", "b").applyInPandas(lambda pdf: _tile(pdf, threshold), schema), "tiled")
    counted = found.where("own").groupBy("node").agg(F.sum("n_links").alias("n_links")).join(nodes.select("node", "copies"), "node")
    own = counted.select("node", F.lit(True).alias("own"), (F.col("n_links") + F.col("copies") - 1).alias("n_links"), F.col("node").alias("root"), F.lit(1.0).alias("recall"))
    return own.unionByName(found.where("node <> root").withColumn("own", F.lit(False)))


def near_links(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cell_max: int = CELL_MAX, tile: int = TILE) -> DataFrame:
    """One row per vector: `vec_id`, `n_links`, `component_id`, `kept` and the audited `recall` of its cell (1 where tiles hold all pairs)."""
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), vector.alias("vector"))
    usable = F.col("label").isNotNull() & F.coalesce(_valid(F.col("vector")), F.lit(False))
    rows = rows.withColumn("node", F.when(usable, F.xxhash64("label", "vector")))
    nodes = rows.where("node is not null").groupBy("label", "vector", "node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    space = Workspace(vectors.sparkSession, "vecgraph")
    nodes = space.table(nodes.withColumn("dim", F.size("vector")), "nodes")
    large = space.table(nodes.groupBy("label", "dim").count().where(F.col("count") > cell_max).select("label", "dim"), "large")
    slim = nodes.select("node", "label", "dim", "vector", "copies").withColumn("own", F.lit(True))
    some_large = large.limit(1).count() > 0
    small = slim.join(large, ["label", "dim"], "left_anti") if some_large else slim
    schema = "node long, own boolean, n_links long, root long, recall double"
    linked = small.groupBy("label", "dim").applyInPandas(lambda pdf: _cell(pdf, threshold), schema)
    if some_large:
        linked = linked.unionByName(_tiled(slim.drop("own").join(large, ["label", "dim"], "left_semi"), cell_max, threshold, tile, space))
    linked = space.table(linked, "links")
    joined = components(linked.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), space)
    ids = nodes.select("node", "least_id").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = ids.groupBy("component").agg(F.min("least_id").alias("component_id"))
    results = ids.join(least, "component").join(linked.where("own"), "node").select("node", "component_id", "n_links", "recall")
    results = space.result(results).withColumnRenamed("node", "r_node")
    out = rows.select("vec_id", "node").join(results, F.col("node") == F.col("r_node"), "left")
    component = F.when(F.col("r_node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
        "recall",
    )
