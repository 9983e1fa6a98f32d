"""Embedding near-dedup with a hierarchical navigable small-world graph per shard.

Equal vectors are one node with a multiplicity. Nodes are dealt by nearness: to the nearest of some
centres, fitted on a bounded sample (``FIT``), and within a centre's cell by hash to shards of about
``SHARD``. Each shard's graph is built once (each layer: the nearest candidates, thinned to diverse
neighbours, links in both directions) and kept as one row. A node is searched in its own graph,
from itself on, and in those before it of its cell and of the cells within reach, from the top; a
link between two shards counts for both of its nodes, so it is searched once. A linked node is at most
``chord`` away, so a node whose distance to the plane between two cells is larger has no links
beyond it: reach is a share of that. Searches are tasks of a bounded number of nodes. A search is
a beam per query, all queries of a block in step. A query whose beam ends above the threshold gets a
wider one until it does not.

One audit sets the reach and the beams of the whole table: a sample of about ``AUDIT`` nodes is compared
with all vectors, once, and searched by beams of each width. Recall is a mean over the sampled nodes
with links to others, apart for those with few and with many links. The least reach is taken that
holds ``REACHED`` of both, then the least width at which both reach ``RECALL``. If none does, all pairs of
shards that can hold links are compared exactly. A sample with too few links to tell takes the whole
reach and beams of ``UNTOLD``. Found pairs are verified in double precision. A task reports each
query's number of links and a spanning forest of the links it found, block by block, so neither
its rows nor its memory grow with the square of a group of near copies.
"""

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import components, mix, written

SHARD = 16384
PARTS = 4             # tasks in which a shard's number of nodes is searched
FIT, FIT_VALUES = 1 << 16, 1 << 24    # vectors and components on which centres are fitted, at most
EACH = 16             # vectors a centre is fitted on, at least
STEPS = 8             # steps of reach, the last of which holds every link
LINKS = 16            # neighbours kept per node and layer; twice as many on the lowest
RATIO = 16            # nodes of a layer per node of the layer above
WIDTHS = (24, 48, 96, 192, 384)
AUDIT = 4096          # nodes that the audit compares with all others
FEW = 8               # more links than these are many
RECALL = 0.995        # mean over the nodes of each kind
REACHED = 0.999       # the same of the links within reach
TOLD, UNTOLD = 16, 96 # nodes with links by which a sample of a larger table tells; the width if it doesn't
OUTSIDE = 4           # neighbours below the threshold that each node and layer keeps besides
ENTRIES = 8           # nodes of a layer from which the layer below is searched
WAYS_IN, ROOM = 3, 8  # nodes below the threshold that lead to a node; links a node gives up to that end
THRESHOLD = 0.95
SLACK = 1e-4          # single-precision search keeps this much below the threshold; doubles decide
BLOCK, ROWS, SPREAD = 512, 256, 8


def _scaled(x: np.ndarray) -> np.ndarray:
    """Doubles with the largest component of each row brought to 1/2..1 by a power of two, which
    changes no cosine and lets no square overflow or vanish."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _layer(u: np.ndarray, ids: np.ndarray, m: int) -> np.ndarray:
    """Neighbours (rows of ``u``, -1 for none) of the nodes ``ids`` among themselves: of the 3 m
    nearest, those nearer to the node than to a neighbour already taken, filled up with the
    nearest; the nearest that are no near duplicates, so that a group larger than that is not on its
    own; then links back where there is room."""
    n, width = len(ids), min(3 * m, max(len(ids) - 1, 0))
    own = m + OUTSIDE
    out = np.full((n, own + m), -1, np.int32)
    if not width:
        return out
    x = u[ids]
    for a in range(0, n, ROWS):
        s = x[a:a + ROWS] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        near = np.argpartition(-s, width - 1, axis=1)[:, :width]
        sim = np.take_along_axis(s, near, 1)
        order = np.argsort(-sim, axis=1)
        near, sim = np.take_along_axis(near, order, 1), np.take_along_axis(sim, order, 1)
        cross = np.einsum("qid,qjd->qij", x[near], x[near])
        keep = np.zeros(near.shape, bool)
        for j in range(width):
            worse = (cross[:, j, :j] > sim[:, j:j + 1]) & keep[:, :j]
            keep[:, j] = ~worse.any(1) & (keep[:, :j].sum(1) < m)
        rank = np.where(keep, 0, width) + np.arange(width)
        pick = np.argsort(rank, axis=1)[:, :m]
        out[a:a + ROWS, :pick.shape[1]] = np.take_along_axis(near, pick, 1)
        # the nearest below the threshold: among those candidates, or else among all
        below = sim < THRESHOLD
        place = np.argsort(~below, axis=1, kind="stable")[:, :OUTSIDE]
        far = np.where(np.take_along_axis(below, place, 1), np.take_along_axis(near, place, 1), -1)
        short = np.flatnonzero((far < 0).any(1) & (width < n - 1))
        if len(short):
            rest = np.where(s[short] >= THRESHOLD, -2, s[short])
            best = np.argpartition(-rest, min(OUTSIDE, n) - 1, axis=1)[:, :OUTSIDE]
            far[short] = np.where(np.take_along_axis(rest, best, 1) > -2, best, -1)
        out[a:a + ROWS, m:m + far.shape[1]] = far
    src = np.repeat(np.arange(n), (out[:, :own] >= 0).sum(1))
    dst = out[:, :own][out[:, :own] >= 0]
    # the links back go first to nodes that few others chose, so that all can be reached
    order = np.lexsort((np.bincount(dst, minlength=n)[src], dst))
    src, dst = src[order], dst[order]
    place = np.arange(len(dst)) - np.searchsorted(dst, dst)
    room = place < m
    out[dst[room], own + place[room]] = src[room]
    out = np.concatenate([out, _ways_in(x, out, np.roll(np.arange(own), OUTSIDE))], axis=1)
    return np.where(out >= 0, ids[out], -1).astype(np.int32)


def _ways_in(x: np.ndarray, out: np.ndarray, order: np.ndarray) -> np.ndarray:
    """More links, at most ROOM from a node, to nodes that fewer than WAYS_IN nodes below the threshold
    lead to: from their own neighbours below it, tried in ``order`` of columns. Without them a pair
    of near duplicates that only hubs chose, or that chose only each other, can't be reached."""
    n = len(x)
    more, used = np.full((n, ROOM), -1, np.int32), np.zeros(n, np.int64)
    ways = np.zeros(n, np.int64)
    far = np.zeros(out.shape, bool)
    for a in range(0, n, ROWS):
        nb = out[a:a + ROWS]
        far[a:a + ROWS] = (nb >= 0) & (np.einsum("id,ijd->ij", x[a:a + ROWS], x[nb]) < THRESHOLD)
        ways += np.bincount(nb[far[a:a + ROWS]], minlength=n)
    for j in order:
        v = np.flatnonzero((ways < WAYS_IN) & far[:, j])
        u = out[v, j]
        turn = np.argsort(u, kind="stable")
        v, u = v[turn], u[turn]
        place = used[u] + np.arange(len(u)) - np.searchsorted(u, u)
        fits = (place < ROOM) & ~(out[u] == v[:, None]).any(1) & ~(more[u] == v[:, None]).any(1)
        more[u[fits], place[fits]] = v[fits]
        np.maximum.at(used, u[fits], place[fits] + 1)
        ways[v[fits]] += 1
    return more


def build(x: np.ndarray, gid: np.ndarray, mult: np.ndarray) -> dict:
    """Graph of a shard: layers from the lowest, each (its nodes, their neighbours)."""
    u = _unit(x)
    rng = np.random.default_rng(5)
    level = np.floor(-np.log(rng.random(len(x))) / np.log(RATIO)).astype(int)
    layers = []
    for j in range(max(1, int(np.ceil(np.log(max(len(x), 2)) / np.log(RATIO))))):
        ids = np.flatnonzero(level >= j)
        if j and len(ids) < 2:
            break
        layers.append((ids, _layer(u, ids, LINKS)))
    return {"x": x, "gid": gid, "mult": mult, "layers": layers}


def _beam(u, nbrs, q, entry, width):
    """Best ``width`` nodes for each query: (ids, similarities), -1 where there are fewer."""
    n, k = len(u), len(q)
    width = min(width, n)
    ids = np.full((k, width), -1, np.int32)
    sim = np.full((k, width), -3, np.float32)
    seen = np.zeros((k, n), bool)
    first = min(entry.shape[1], width)
    entry = np.sort(entry[:, :first], axis=1)
    again = np.zeros(entry.shape, bool)
    again[:, 1:] = entry[:, 1:] == entry[:, :-1]
    ids[:, :first] = np.where(again, -1, entry)
    sim[:, :first] = np.where(again, -3, np.einsum("qed,qd->qe", u[entry], q))
    seen[np.arange(k)[:, None], entry] = True
    open_ = sim > -3
    live = np.arange(k)
    expand = min(max(4, width // SPREAD), width)          # wide beams take more nodes a step
    while len(live):
        rank = np.where(open_[live], sim[live], -4)
        top = np.argpartition(rank, width - expand, axis=1)[:, -expand:]
        good = np.take_along_axis(rank, top, 1) > -4
        some = good.any(1)
        live, top, good = live[some], top[some], good[some]
        if not len(live):
            break
        at = np.where(good, np.take_along_axis(ids[live], top, 1), 0)
        o = open_[live]
        np.put_along_axis(o, top, False, 1)
        cand = np.where(good[:, :, None], nbrs[at], -1).reshape(len(live), -1)
        cand = np.sort(cand, axis=1)
        new = cand >= 0
        new[:, 1:] &= cand[:, 1:] != cand[:, :-1]
        new &= ~seen[live[:, None], np.where(cand >= 0, cand, 0)]
        r, c = np.nonzero(new)
        seen[live[r], cand[r, c]] = True
        got = np.full(cand.shape, -3, np.float32)
        got[r, c] = np.einsum("nd,nd->n", u[cand[r, c]], q[live[r]])
        all_ids = np.concatenate([ids[live], cand], axis=1)
        all_sim = np.concatenate([sim[live], got], axis=1)
        all_open = np.concatenate([o, got > -3], axis=1)
        best = np.argpartition(all_sim, all_sim.shape[1] - width, axis=1)[:, -width:]
        ids[live], sim[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sim, best, 1)
        open_[live] = np.take_along_axis(all_open, best, 1)
    return ids, sim


def _hits(g: dict, u: np.ndarray, q: np.ndarray, width: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, nodes) of the similarities over the threshold, block by block: those that beams of
    at least ``width`` find, or with a width of 0 all."""
    if not width:
        for a in range(0, len(q), BLOCK):
            r, c = np.nonzero(q[a:a + BLOCK] @ u.T >= threshold)
            yield r + a, c
        return
    nbrs = []
    for ids, nb in g["layers"]:
        full = np.full((len(u), nb.shape[1]), -1, np.int32)
        full[ids] = nb
        nbrs.append(full)
    top = g["layers"][-1][0]
    top = np.resize(top, max(len(top), ENTRIES))
    own = g.get("own", np.full(len(q), -1))
    for a in range(0, len(q), BLOCK):
        part = q[a:a + BLOCK]
        start = np.repeat(own[a:a + BLOCK, None], ENTRIES, axis=1)     # a node of the graph is its own way in
        far = np.flatnonzero(start[:, 0] < 0)
        if len(far):
            some = top[np.argsort(-(part[far] @ u[top].T), axis=1)[:, :ENTRIES]]
            for j in range(len(nbrs) - 2, 0, -1):
                ids, sim = _beam(u, nbrs[j], part[far], some, 2 * ENTRIES)
                some = np.take_along_axis(ids, np.argsort(-sim, axis=1), 1)[:, :ENTRIES]
                some = np.where(some >= 0, some, some[:, :1])
                some = some[:, np.arange(ENTRIES) % some.shape[1]]
            start[far] = some
        todo, w = np.arange(len(part)), width
        while len(todo):
            ids, sim = _beam(u, nbrs[0], part[todo], start[todo], w)
            full = (sim.min(1) >= threshold) & (w < len(u))        # the beam may have cut links off
            r, c = np.nonzero((sim >= threshold) & ~full[:, None])
            yield todo[r] + a, ids[r, c]
            todo, w = todo[full], w * 4


def _own(g: dict, gid: np.ndarray) -> dict:
    """The graph, with the nodes that the queries ``gid`` are themselves (-1 for none)."""
    order = np.argsort(g["gid"], kind="stable")
    at = order[np.minimum(np.searchsorted(g["gid"], gid, sorter=order), len(order) - 1)]
    return g | {"own": np.where(g["gid"][at] == gid, at, -1)}


class _Forest:
    """Spanning forest of links between queries and nodes, which come in any number of pieces."""

    def __init__(self, queries: int, nodes: int):
        self.label, self.queries, self.links = np.arange(queries + nodes), queries, []

    def add(self, qi: np.ndarray, ui: np.ndarray) -> None:
        """Unites in growing pieces: once a group is one tree, each further query of it costs one
        link and not one per member."""
        order = np.argsort(qi, kind="stable")
        qi, ui = qi[order], ui[order] + self.queries
        starts = np.flatnonzero(np.concatenate([[True], qi[1:] != qi[:-1]])) if len(qi) else []
        at, size = 0, 1
        while at < len(starts):
            lo, hi = starts[at], starts[at + size] if at + size < len(starts) else len(qi)
            self._unite(qi[lo:hi], ui[lo:hi])
            at, size = at + size, size * 2

    def _unite(self, a: np.ndarray, b: np.ndarray) -> None:
        pairs = np.unique(np.stack([self.label[a], self.label[b]], 1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while root.setdefault(v, v) != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        for x, y in pairs.tolist():
            r, s = find(x), find(y)
            if r != s:
                root[max(r, s)] = min(r, s)
                self.links.append((x, y))             # labels are members of their trees
        if root:
            old = np.fromiter(root, np.int64, len(root))
            new = self.label.copy()
            moved = np.arange(len(new))
            moved[old] = [find(int(v)) for v in old]
            self.label = moved[new]


def audit_shard(g: dict, sample: dict, threshold: float, step=None) -> pd.DataFrame:
    """For each sampled node with links to others in the shard: their number and, for each width,
    how many of them the beams find; with ``step``, which takes rows of the sample and nodes, for each
    step of reach apart."""
    u, q = _unit(g["x"]), _unit(sample["x"])
    low = threshold - SLACK

    def count(width: int, rows: np.ndarray) -> np.ndarray:
        n = np.zeros((len(rows), STEPS + 1), np.int64)
        for r, c in _hits(_own(g, sample["gid"][rows]), u, q[rows], width, low):
            other = sample["gid"][rows[r]] != g["gid"][c]
            r, c = r[other], c[other]
            np.add.at(n, (r, step(rows[r], c) if step else 0), 1)
        return n

    true = count(0, np.arange(len(q)))
    some = np.flatnonzero(true.any(1))
    true = true[some]
    row, k = np.nonzero(true)
    out = pd.DataFrame({"gid": sample["gid"][some[row]], "step": k, "links": true[row, k]})
    for w in WIDTHS:
        out[f"w{w}"] = np.minimum(count(w, some), true)[row, k]
    return out


def reach_step(recalls: list, whole: bool) -> int:
    """The least step of reach that holds REACHED of the links of both kinds. ``recalls``: for each
    kind that has nodes (their number, [mean share of the links held by each step])."""
    if not whole and sum(n for n, _ in recalls) < TOLD:
        return STEPS
    return next(k for k in range(STEPS + 1) if k == STEPS or all(r[k] >= REACHED for _, r in recalls))


def beam_width(recalls: list, whole: bool) -> int:
    """The least width at which the mean recall of both kinds passes, 0 if none does. ``recalls``:
    for each kind that has nodes (their number, {width: mean recall}); ``whole``: all nodes were
    sampled."""
    if not whole and sum(n for n, _ in recalls) < TOLD:
        return UNTOLD
    return next((w for w in WIDTHS if all(r[w] >= RECALL for _, r in recalls)), 0)


def link_shards(g: dict, other: dict, threshold: float, width: int):
    """Links of the nodes of ``other`` to the nodes of the graph ``g``: the number of linked vectors of
    each node of ``other`` and of each of ``g``, and a spanning forest."""
    u, q = _unit(g["x"]), _unit(other["x"])
    x, y = _scaled(other["x"]), _scaled(g["x"])
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    links, back = np.zeros(len(q), np.int64), np.zeros(len(u), np.int64)
    forest = _Forest(len(q), len(u))
    for qi, ui in _hits(_own(g, other["gid"]), u, q, width, threshold - SLACK):
        keep = other["gid"][qi] != g["gid"][ui]
        qi, ui = qi[keep], ui[keep]
        ok = np.empty(len(qi), bool)
        for a in range(0, len(qi), 100_000):
            i, j = qi[a:a + 100_000], ui[a:a + 100_000]
            ok[a:a + 100_000] = (x[i] * y[j]).sum(1) / np.sqrt(xx[i] * yy[j]) >= threshold
        qi, ui = qi[ok], ui[ok]
        links += np.bincount(qi, g["mult"][ui], minlength=len(q)).astype(np.int64)
        back += np.bincount(ui, other["mult"][qi], minlength=len(u)).astype(np.int64)
        forest.add(qi, ui)
    names = np.concatenate([other["gid"], g["gid"]])
    a, b = names[np.array(forest.links, np.int64).reshape(-1, 2)].T
    return links, back, a, b


def fit_centres(u: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """At most ``n`` unit centres of unit vectors, each near those nearer to it than to the others."""
    c = u[np.random.default_rng(11).permutation(len(u))[:n]]
    for _ in range(rounds):
        near = nearest(u, c)
        total = np.zeros((len(c), u.shape[1]))
        np.add.at(total, near, u)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-6, total / np.maximum(size, 1e-6), c).astype(np.float32)
    return np.unique(c, axis=0)


def nearest(u: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[(u[a:a + 1024] @ centres.T).argmax(1) for a in range(0, len(u), 1024)]])


def step_to(u: np.ndarray, cell: np.ndarray, into: np.ndarray, centres: np.ndarray, threshold: float) -> np.ndarray:
    """Step of reach at which each vector of ``cell`` is searched in the cell ``into``, 0 in its own. Its
    distance to the plane between the two centres is at most that to any vector behind it, and the
    distance of linked vectors at most the chord of the threshold."""
    gap = centres[cell] - centres[into]
    away = (u * gap).sum(1) / np.maximum(np.linalg.norm(gap, axis=1), 1e-6)
    return _steps(away, threshold) * (cell != into)


def _steps(away: np.ndarray, threshold: float) -> np.ndarray:
    """1 to STEPS, and STEPS + 1 beyond the chord."""
    chord = np.sqrt(max(2 - 2 * threshold, 0)) + SLACK
    return np.clip(np.ceil(away / chord * STEPS), 1, STEPS + 1).astype(np.int64)


def asked_cells(u: np.ndarray, cell: np.ndarray, centres: np.ndarray, threshold: float, reach: int):
    """(vectors, cells): the cells before its own that each vector is searched in."""
    got = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a in range(0, len(u), 256):
        x, own = u[a:a + 256], cell[a:a + 256]
        s = x @ centres.T
        gap = np.sqrt(np.maximum(2 - 2 * (centres[own] @ centres.T), 1e-12))
        away = (s[np.arange(len(x)), own][:, None] - s) / gap
        r, c = np.nonzero((_steps(away - 1e-5 / gap, threshold) <= reach) & (np.arange(len(centres)) < own[:, None]))
        got.append((r + a, c))
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding",
                    threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row of ``vectors``: the number of other rows
    with cosine >= threshold (double precision), the least id reachable by links, and whether the
    row is that one.

    Vectors that are null, empty, zero or hold a null or a non-finite component link with nothing,
    and neither do vectors of different lengths. Equal vectors (repeated rows too) are linked. Null
    ids are never the least. Extra columns are not read; an empty table gives no rows.
    """
    v = F.col(vec)
    values = F.transform(v, lambda c: c.cast("double"))
    sound = (v.isNotNull() & (F.size(v) > 0) & ~F.exists(values, lambda c: c.isNull() | F.isnan(c)
             | (F.abs(c) == float("inf"))) & F.exists(values, lambda c: c != 0))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"), F.coalesce(sound, F.lit(False)).alias("sound"))
    rows = rows.withColumn("gid", F.when(F.col("sound"), F.xxhash64("v")))
    nodes = written(rows.filter("sound").groupBy("gid").agg(F.first("v").alias("v"), F.count("*").alias("mult"))
                    .withColumn("d", F.size("v")), "vectors")
    sizes = nodes.groupBy("d").count().collect()                       # a row per vector length
    if not sizes:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                           F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    count = {r["d"]: max(1, -(-r["count"] // shard)) for r in sizes}

    def packed(pdf: pd.DataFrame) -> dict:
        pdf = pdf.sort_values("gid")
        return {"x": np.stack(pdf["v"].to_list()), "gid": pdf["gid"].to_numpy(), "mult": pdf["mult"].to_numpy()}

    def drawn(seed: int, most: dict) -> DataFrame:
        """About so many nodes of each vector length."""
        of = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r["d"], min(1.0, most[r["d"]] / r["count"]))]), F.col("d"))
        return nodes.filter(F.pmod(F.xxhash64("gid", F.lit(seed)), F.lit(1 << 20)) < of * (1 << 20))

    # cells: centres of a bounded sample, and each node's nearest
    centres = {d: np.zeros((1, d), np.float32) for d in count}
    fit = {d: min(FIT, max(EACH, FIT_VALUES // d)) for d in count}
    if max(count.values()) > 1:
        wanted = {d: min(n, fit[d] // EACH) for d, n in count.items()}

        def centre(pdf: pd.DataFrame) -> pd.DataFrame:
            d, v = pdf["d"].iloc[0], packed(pdf)
            return pd.DataFrame({"d": [d], "c": [pickle.dumps(fit_centres(_unit(v["x"]), wanted[d]), 5)]})

        for r in drawn(17, fit).groupBy("d").applyInPandas(centre, "d int, c binary").collect():    # centres only
            centres[r["d"]] = pickle.loads(r["c"]) if count[r["d"]] > 1 else centres[r["d"]]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, rows in pdf.groupby("d"):
                yield rows.assign(cell=nearest(_unit(np.stack(rows["v"].to_list())), centres[d]))

    element = nodes.schema["v"].dataType.elementType.simpleString()
    dealt = written(nodes.select("gid", "v", "mult", "d").mapInPandas(
        deal, f"gid long, v array<{element}>, mult long, d int, cell int"), "cells")
    split = {d: np.ones(len(c), np.int64) for d, c in centres.items()}
    for r in dealt.groupBy("d", "cell").count().collect():                 # a row per cell
        split[r["d"]][r["cell"]] = max(1, round(r["count"] / shard))
    first = {d: np.concatenate([[0], np.cumsum(n)]) for d, n in split.items()}          # a cell's shards
    cell_of = {d: np.repeat(np.arange(len(n)), n) for d, n in split.items()}

    def shard_of(d: int, gid: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return first[d][cell] + (mix(gid.astype(np.uint64)) % split[d][cell].astype(np.uint64)).astype(np.int64)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, rows in pdf.groupby("d"):
                yield rows.assign(shard=shard_of(d, rows["gid"].to_numpy(), rows["cell"].to_numpy())).drop(columns="cell")

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"d": [pdf["d"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "g": [pickle.dumps(build(**packed(pdf)), 5)]})

    shards = sum(int(n.sum()) for n in split.values())
    placed = dealt.mapInPandas(place, f"gid long, v array<{element}>, mult long, d int, shard int")
    graphs = written(placed.repartition(shards, "d", "shard").groupBy("d", "shard")
                     .applyInPandas(graph, "d int, shard int, g binary"), "graphs")

    # the audit: a sample of each vector length against all shards, once
    sample = drawn(13, dict.fromkeys(count, AUDIT)).groupBy("d").applyInPandas(
        lambda pdf: pd.DataFrame({"d": [pdf["d"].iloc[0]], "s": [pickle.dumps(packed(pdf), 5)]}), "d int, s binary")

    def audit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, shard, g, s in zip(pdf["d"], pdf["shard"], pdf["g"], pdf["s"], strict=True):
                g, s, here = pickle.loads(g), pickle.loads(s), cell_of[d][shard]
                u, q = _unit(g["x"]), _unit(s["x"])
                cell = nearest(q, centres[d])

                def step(r, c, u=u, q=q, cell=cell, here=here, d=d):
                    later = cell[r] > here                          # the later one is searched
                    x = np.where(later[:, None], q[r], u[c])
                    k = step_to(x, np.maximum(cell[r], here), np.minimum(cell[r], here), centres[d], threshold)
                    return np.minimum(k, STEPS)

                yield audit_shard(g, s, threshold, step).assign(d=d)[["d", "gid", "step", "links", *wide]]

    wide = [f"w{w}" for w in WIDTHS]
    held = graphs.join(sample, "d").select("d", "shard", "g", "s").repartition(shards)
    told = held.mapInPandas(audit, "d int, gid long, step int, links long, " + ", ".join(f"{w} long" for w in wide))
    told = told.groupBy("d", "gid").agg(F.sum("links").alias("all"), *[
        F.sum(F.when(F.col("step") <= k, F.col(c))).alias(f"{c}_{k}") for c in ("links", *wide) for k in range(STEPS + 1)])
    kinds = told.groupBy("d", (F.col("all") > FEW).alias("many")).agg(F.count("*").alias("n"), *[
        F.avg(F.coalesce(f"{c}_{k}", F.lit(0)) / F.col("all")).alias(f"{c}_{k}")
        for c in ("links", *wide) for k in range(STEPS + 1)]).collect()                                  # two rows a length
    width, reach = {}, {}
    for r in sizes:
        d, whole, mine = r["d"], r["count"] <= AUDIT, [k for k in kinds if k["d"] == r["d"]]
        reach[d] = reach_step([(k["n"], [k[f"links_{i}"] for i in range(STEPS + 1)]) for k in mine], whole)
        width[d] = beam_width([(k["n"], {w: k[f"w{w}_{reach[d]}"] for w in WIDTHS}) for k in mine], whole)
        if not width[d]:
            reach[d] = STEPS

    def asked(rows: pd.DataFrame, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, shards, the row's own): the shards that each node of a frame is searched in."""
        gid, cell = rows["gid"].to_numpy(), rows["cell"].to_numpy()
        own = shard_of(d, gid, cell)
        r, c = asked_cells(_unit(np.stack(rows["v"].to_list())), cell, centres[d], threshold, reach[d])
        lo = np.concatenate([first[d][cell], first[d][c]])              # its cell up to its shard, other cells whole
        n = np.concatenate([own + 1 - first[d][cell], split[d][c]])
        row = np.repeat(np.concatenate([np.arange(len(gid)), r]), n)
        to = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return row, to, to == own[row]

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, rows in pdf.groupby("d"):
                n = np.bincount(asked(rows, d)[1])
                yield pd.DataFrame({"d": d, "shard": np.flatnonzero(n), "n": n[n > 0]})

    tasks_of = {d: np.ones(len(c), np.int64) for d, c in cell_of.items()}
    for r in dealt.mapInPandas(tally, "d int, shard int, n long").groupBy("d", "shard").agg(F.sum("n").alias("n")).collect():
        tasks_of[r["d"]][r["shard"]] = -(-r["n"] * PARTS // shard)                             # a row per shard

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, rows in pdf.groupby("d"):
                row, to, home = asked(rows, d)
                part = mix(rows["gid"].to_numpy().astype(np.uint64) + np.uint64(1))[row] % tasks_of[d][to].astype(np.uint64)
                for a in range(0, len(row), 10_000):
                    yield rows[["gid", "v", "mult", "d"]].iloc[row[a:a + 10_000]].assign(
                        shard=to[a:a + 10_000], part=part[a:a + 10_000].astype(np.int64), home=home[a:a + 10_000])

    def copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, shard, g in zip(pdf["d"], pdf["shard"], pdf["g"], strict=True):
                for part in range(tasks_of[d][shard]):
                    yield pd.DataFrame({"d": [d], "shard": [shard], "part": [part], "g": [g]})

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": [], "b": [], "n": []}, dtype=np.int64)]
        g = pickle.loads(left["g"].iloc[0])
        for home, rows in right.groupby("home"):
            q = packed(rows)
            links, back, a, b = link_shards(g, q, threshold, width[rows["d"].iloc[0]])
            some = [(q["gid"], links)] + [(g["gid"], back)] * (not home)
            node = np.concatenate([ids[n > 0] for ids, n in some])
            out.append(pd.DataFrame({"a": np.concatenate([node, a]), "b": np.concatenate([node, b]),
                                     "n": np.concatenate([*[n[n > 0] for _, n in some], np.zeros(len(a), np.int64)])}))
        return pd.concat(out)

    key, tasks = ["d", "shard", "part"], sum(int(n.sum()) for n in tasks_of.values())
    sides = graphs.mapInPandas(copies, "d int, shard int, part int, g binary").repartition(tasks, *key)
    queries = dealt.mapInPandas(ask, f"gid long, v array<{element}>, mult long, d int, shard int, part int, home boolean")
    found = written(sides.groupBy(*key).cogroup(queries.repartition(tasks, *key).groupBy(*key))
                    .applyInPandas(search, "a long, b long, n long"), "links")
    degree = found.groupBy(F.col("a").alias("gid")).agg(F.sum("n").alias("n"))
    comp = components(found.filter("a <> b").select("a", "b"))
    whole = (rows.select("id", "gid").join(nodes.select("gid", "mult"), "gid", "left").join(degree, "gid", "left")
             .join(comp.withColumnRenamed("node", "gid"), "gid", "left")
             .withColumn("c", F.coalesce("component", "gid")))
    least = whole.filter("c is not null").groupBy("c").agg(F.min("id").alias("least"))
    out = whole.join(least, "c", "left").withColumn("component_id", F.when(F.col("gid").isNull(), F.col("id")).otherwise(F.col("least")))
    return out.select(F.col("id").alias(id_col),
                      (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("mult") - 1, F.lit(0))).cast("long").alias("n_links"),
                      "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
