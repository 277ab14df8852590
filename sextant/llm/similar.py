"""Most similar vectors by a hierarchical k-means tree with best-bin-first traversal (problem 3).

The tree is fitted on a bounded sample (``SAMPLE`` vectors, chosen by hash; 16 for each leaf where that is more, ``MOST_SAMPLED`` at most) on
the driver, and its centres go to every task.  Every vector lies in one leaf.  A query visits leaves best bin first: a priority
queue holds the nodes still to look at, keyed by how far the query lies beyond the border to them, and the nearest is popped next.
The query goes on until the share of its neighbours that popped leaves are expected to hold reaches ``theta``: what a leaf or an unopened
node holds is its members times the density of neighbours at its key, so each query widens its visit by what still waits in its own queue.
Density and ``theta`` come from queries held out of the fit: ``theta`` is the least at which the wanted recall of their true neighbours is reached.

Spark routes vectors to leaves; each (leaf, block) is compared in one task by matrix products.  Popular leaves are cut
into blocks of members and of visitors, so that no group is unbounded.  Equal vectors with different ids go through the tree once, as a
class; its members get their neighbours by a join afterwards.

Defined results: usable are vectors with exactly ``dim`` finite values that are not all zero; others have no
neighbours. A repeated id counts once (its least embedding). Ties go to the smaller id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.session import materialise

#: Vectors that the tree is fitted on at least and at most, held-out queries that calibrate it (on top of those), branches of a node.
SAMPLE, MOST_SAMPLED, CALIBRATION, BRANCH = 20_000, 320_000, 4_000, 16
#: Members and visitors of one block at most (predicted from the sample).
MEMBER_BLOCK, VISITOR_BLOCK = 32_768, 131_072
#: Rows that go down the tree together, and similarities that are held at a time.
WALK, CELLS = 4_096, 8_000_000
#: Ids or classes up to which a list of them is broadcast (some bytes each); beyond it the join shuffles.
ID_LIMIT = 100_000


# ------------------------------------------------------------------ vectors


def usable_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dim: int = 96) -> DataFrame:
    """(vec_id, v): unit vectors as float32 bytes; rows that repeat an id are still there."""

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b[vector].cast(pa.large_list(pa.float32()))
            lengths = np.asarray(lists.value_lengths().fill_null(-1))
            right = np.flatnonzero(lengths == dim)
            flat = lists.take(pa.array(right)).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(right), dim)
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            good = np.isfinite(norm) & (norm > 0)
            x = (x[good] / norm[good, None]).astype(np.float32)
            ids = b[id_col].take(pa.array(right[good]))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), _to_binary(x)], names=["vec_id", "v"])

    rows = df.select(id_col, vector).filter(F.col(id_col).isNotNull() & (F.size(vector) == dim))
    return rows.mapInArrow(unit, "vec_id long, v binary")


def _listed(keys: DataFrame) -> tuple[DataFrame, int]:
    """A written list of keys, broadcast if it is short, and its length."""
    n = keys.count()
    return (F.broadcast(keys) if n <= ID_LIMIT else keys), n


def settled(vectors: DataFrame) -> DataFrame:
    """``vectors`` with one vector per id, the least one of several; rows that are wholly equal may stay.

    Only ids and hashes are shuffled to find ids that come with different vectors, and only the vectors of those are
    grouped.  Equal rows end up in the same block and are dropped there.
    """
    h = F.xxhash64("v")
    odd = vectors.select("vec_id", h.alias("h")).groupBy("vec_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("vec_id")
    listed, n = _listed(materialise(odd, "vector-ids"))
    if n == 0:
        return vectors
    one = vectors.join(listed, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    return vectors.join(listed, "vec_id", "left_anti").unionByName(one)


def _to_binary(x: np.ndarray) -> pa.Array:
    n, d = x.shape
    data = pa.py_buffer(np.ascontiguousarray(x, np.float32).tobytes())
    offsets = pa.py_buffer((np.arange(n + 1, dtype=np.int32) * (4 * d)).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, data])


def _from_binary(col, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    if len(col) == 0:
        return np.zeros((0, dim), np.float32)
    col = col.cast(pa.large_binary())
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(data, np.float32, count=len(col) * dim, offset=int(at[0])).reshape(len(col), dim)


# ------------------------------------------------------------------ tree


@dataclass
class Tree:
    """Nodes by number; ``children[i]`` is empty for a leaf, whose number among the leaves is ``leaf[i]``.

    ``share``: part of all vectors below each node; ``density[i]``: neighbours for each member at keys up to ``bounds[i]``;
    ``members`` and ``visitors``: predicted vectors and visits for each leaf, as parts of all vectors.
    """

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray
    share: np.ndarray
    bounds: np.ndarray
    density: np.ndarray
    theta: float = 2.0
    members: np.ndarray | None = None
    visitors: np.ndarray | None = None

    @property
    def n_leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def margins(self, x: np.ndarray, node: int) -> np.ndarray:
        """How far each row lies beyond the border between the nearest child of ``node`` and each other one."""
        kids = self.centres[self.children[node]]
        d2 = ((kids**2).sum(1)[None, :] - 2.0 * (x @ kids.T)).astype(np.float64)
        best = d2.argmin(1)
        gap = np.sqrt(np.maximum(((kids[:, None, :] - kids[None, :, :]) ** 2).sum(2), 1e-12))
        return np.maximum(d2 - d2[np.arange(len(x)), best][:, None], 0.0) / (2.0 * gap[best])

    def expected(self, keys: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Neighbours that the members below ``nodes`` are expected to hold."""
        return self.density[np.searchsorted(self.bounds, keys)] * self.share[nodes]

    def best_bin_first(self, x: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, reached): the leaves that each row pops from its priority queue until the share reaches ``theta``.

        ``reached``: the share before the leaf was popped, so a leaf is visited under every larger ``theta``. Leaves of a row come in the order
        in which they are popped; the first is the one that the row lies in.
        """
        parts = [self._walk(x[s : s + WALK], theta, s) for s in range(0, len(x), WALK)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))  # type: ignore[return-value]

    def _walk(self, x: np.ndarray, theta: float, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """:meth:`best_bin_first` of some rows: one queue (a line of each array) per row, every row pops one node a turn."""
        n, width = len(x), self.n_leaves
        keys, nodes, held = np.full((n, width), np.inf), np.zeros((n, width), np.int64), np.zeros((n, width))
        keys[:, 0], held[:, 0] = 0.0, self.expected(np.zeros(1), np.zeros(1, np.int64))[0]
        used, found, queued, reached = np.ones(n, np.int64), np.zeros(n), held[:, 0].copy(), np.zeros(n)
        rows, leaves, shares = [], [], []
        active = np.arange(n)
        while len(active):
            front = keys[active, : used[active].max()]
            at = front.argmin(1)
            key = front[np.arange(len(active)), at]
            total = found[active] + queued[active]
            reached[active] = np.maximum(reached[active], found[active] / np.where(total > 0, total, 1.0))
            on = np.isfinite(key) & (reached[active] < theta)
            active, at, key = active[on], at[on], key[on]
            node = nodes[active, at]
            number = self.leaf[node]
            done = number >= 0
            a, c = active[done], at[done]
            rows.append(a + first)
            leaves.append(number[done])
            shares.append(reached[a])
            found[a] += held[a, c]
            queued[a] -= held[a, c]
            keys[a, c] = np.inf
            inner = np.flatnonzero(~done)
            inner = inner[np.argsort(node[inner], kind="stable")]
            for group in np.split(inner, np.flatnonzero(np.diff(node[inner])) + 1) if len(inner) else ():
                a, c, kids = active[group], at[group], self.children[node[group[0]]]
                k = np.maximum(self.margins(x[a], int(node[group[0]])), key[group][:, None])
                mass = self.expected(k, np.broadcast_to(kids, k.shape))
                queued[a] += mass.sum(1) - held[a, c]
                # the first child takes the place of its parent, the others come behind
                places = np.concatenate([c[:, None], used[a][:, None] + np.arange(len(kids) - 1)[None, :]], axis=1)
                line = np.broadcast_to(a[:, None], places.shape)
                keys[line, places], nodes[line, places], held[line, places] = k, np.broadcast_to(kids, k.shape), mass
                used[a] += len(kids) - 1
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return np.concatenate(rows), np.concatenate(leaves), np.concatenate(shares)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf in which each row lies: the nearest child all the way down."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            kids = self.children[node]
            if len(kids) == 0:
                out[at] = self.leaf[node]
                continue
            near = self.margins(x[at], node).argmin(1)
            todo += [(int(kid), at[near == j]) for j, kid in enumerate(kids) if (near == j).any()]
        return out


def _lloyd(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of k-means; begins with spread-out rows."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = ((centres**2).sum(1)[None, :] - 2.0 * (x @ centres.T)).argmin(1)
        for j in range(k):
            if (mine := own == j).any():
                centres[j] = x[mine].mean(0)
    return centres


def n_leaves(n_total: int) -> float:
    """About sqrt(n) / 24 leaves: the members that a query meets and the leaves between which vectors are copied grow alike slowly."""
    return max(1.0, n_total**0.5 / 24)


def fit(sample: np.ndarray, n_total: int, branch: int = BRANCH) -> Tree:
    """A tree over the sample with about :func:`n_leaves` leaves."""
    want = max(16, int(len(sample) / n_leaves(n_total)))
    centres, children, leaves = [sample.mean(0) if len(sample) else np.zeros(1, np.float32)], [np.zeros(0, np.int64)], [-1]
    sizes = [len(sample)]
    todo = [(0, np.arange(len(sample)))]
    count = 0
    while todo:
        node, at = todo.pop()
        k = min(branch, max(2, -(-len(at) // want)))
        if len(at) > want:
            c = _lloyd(sample[at], k)
            own = ((c**2).sum(1)[None, :] - 2.0 * (sample[at] @ c.T)).argmin(1)
            kept = [j for j in range(k) if (own == j).any()]
            if len(kept) > 1:
                kids = []
                for j in kept:
                    kids.append(len(centres))
                    centres.append(c[j])
                    children.append(np.zeros(0, np.int64))
                    leaves.append(-1)
                    sizes.append(int((own == j).sum()))
                children[node] = np.array(kids)
                todo += [(kid, at[own == j]) for kid, j in zip(kids, kept, strict=True)]
                continue
        leaves[node] = count
        count += 1
    number, size = np.array(leaves), np.array(sizes, np.float64)
    share = size / max(len(sample), 1)
    members = np.zeros(count)
    members[number[number >= 0]] = (size[number >= 0] + 3) / max(len(sample), 1)  # what the sample may have missed
    return Tree(np.asarray(centres, np.float32), children, number, share, np.zeros(0), np.ones(1), members=members)


def _true_links(queries: np.ndarray, own: np.ndarray, sample: np.ndarray, k: int, min_sim: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, row of the sample) of the queries' true neighbours; ``own``: the row of each query itself."""
    a, b, kk = [], [], min(k, len(sample) - 1)
    step = max(1, CELLS // max(len(sample), 1))
    for s in range(0, len(queries), step) if kk > 0 else ():
        sims = queries[s : s + step] @ sample.T
        sims[np.arange(len(sims)), own[s : s + step]] = -2
        near = np.argpartition(-sims, kk - 1, axis=1)[:, :kk]
        ok = sims[np.arange(len(sims))[:, None], near] >= min_sim
        a.append(s + np.nonzero(ok)[0])
        b.append(near[ok])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def calibrate(tree: Tree, sample: np.ndarray, n_held: int, recall: float, k: int, min_sim: float, both: bool) -> Tree:
    """Sets density, ``theta`` and visitors from the last ``n_held`` rows of ``sample``, which the fit has not seen.

    One half of them gives the density of neighbours by key, the other half the ``theta`` of the wanted recall.
    ``both``: a link counts if either end visits the other's leaf, since every vector is a query.
    """
    home = tree.home(sample)
    held = np.arange(len(sample) - n_held, len(sample))
    first, second = held[::2], held[1::2]
    # density of neighbours by key
    a, b = _true_links(sample[first], first, sample, k, min_sim)
    key = _all_keys(tree, sample[first])
    if len(a):
        tree.bounds = np.unique(np.quantile(key[a, home[b]], np.linspace(0, 1, 25)))
        bins = np.searchsorted(tree.bounds, key)
        links = np.bincount(np.searchsorted(tree.bounds, key[a, home[b]]), minlength=len(tree.bounds) + 1)
        members = np.bincount(bins.ravel(), weights=np.broadcast_to(tree.members, key.shape).ravel(), minlength=len(tree.bounds) + 1)
        tree.density = np.minimum.accumulate((links + 0.01) / np.maximum(members, 1e-9))
    # the least theta that reaches the recall
    a, b = _true_links(sample[second], second, sample, k, min_sim)
    if recall >= 1 or not len(a):
        tree.theta = 2.0 if recall >= 1 else 0.0
    else:
        need = _reached(tree, sample[second])[a, home[b]]
        if both:
            ends, at = np.unique(b, return_inverse=True)
            need = np.minimum(need, _reached(tree, sample[ends])[at, home[second[a]]])
        tree.theta = float(np.quantile(need, recall, method="higher")) + 1e-9
    _, leaves, _ = tree.best_bin_first(sample[held], tree.theta)
    tree.visitors = (np.bincount(leaves, minlength=tree.n_leaves) + 1.0) / max(len(held), 1)
    return tree


def _all_keys(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The key of every leaf for each row."""
    out, todo = np.zeros((len(x), tree.n_leaves)), [(0, np.zeros(len(x)))]
    while todo:
        node, key = todo.pop()
        if len(tree.children[node]) == 0:
            out[:, tree.leaf[node]] = key
            continue
        m = np.maximum(tree.margins(x, node), key[:, None])
        todo += [(int(kid), m[:, j]) for j, kid in enumerate(tree.children[node])]
    return out


def _reached(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The share before each leaf is popped, for each row."""
    rows, leaves, reached = tree.best_bin_first(x, np.inf)
    out = np.ones((len(x), tree.n_leaves))
    out[rows, leaves] = reached
    return out


# ------------------------------------------------------------------ search


def sample_of(vectors: DataFrame, size: int, dim: int = 96) -> np.ndarray:
    """At most ``size`` vectors, those with the least hashes of their ids (a bounded number reaches the driver)."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).select("v").toArrow()
    return _from_binary(rows["v"], dim) if rows.num_rows else np.zeros((0, dim), np.float32)


def build(vectors: DataFrame, recall: float = 0.99, k: int = 10, min_sim: float = -1.0, both: bool = True, dim: int = 96) -> tuple[Tree, int]:
    """A calibrated tree for ``vectors`` (vec_id, v), and their number."""
    n = vectors.count()
    size = min(MOST_SAMPLED, max(SAMPLE, int(16 * n_leaves(n)))) + CALIBRATION
    sample = sample_of(vectors, size, dim)
    held = min(CALIBRATION, len(sample) // 5)
    return calibrate(fit(sample[: len(sample) - held], n), sample, held, recall, k, min_sim, both), n


def one_leaf(dim: int = 96, visitors: float = 1.0) -> Tree:
    """A tree that does not tell vectors apart: searching it is an exact search in blocks."""
    one = np.ones(1)
    return Tree(np.zeros((1, dim), np.float32), [np.zeros(0, np.int64)], np.array([0]), one, np.zeros(0), one, members=one, visitors=one * visitors)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashed(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.uint64) * _MIX
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(8)).astype(np.int64)


def _route(vectors: DataFrame, tree: Tree, n: int, query_if, self_join: bool, dim: int) -> DataFrame:
    """Rows (leaf, member block, visitor block, role, vec_id, v). Roles: 0 member compared among its block, 1 member copy, 2 visitor."""
    spark = vectors.sparkSession
    mb = np.maximum(1, np.ceil(tree.members * n / MEMBER_BLOCK)).astype(np.int64)
    vb = np.maximum(1, np.ceil(tree.visitors * n / VISITOR_BLOCK)).astype(np.int64)
    shared = spark.sparkContext.broadcast((tree, mb, vb))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, m_blocks, v_blocks = shared.value
        for b in batches:
            ids = b["vec_id"].to_numpy(zero_copy_only=False).astype(np.int64)
            if len(ids) == 0:
                continue
            x = _from_binary(b["v"], dim)
            h = _hashed(ids)
            home = t.home(x)
            my_block = h % m_blocks[home]
            asks = query_if(ids)
            # members, a copy for every block of visitors
            reps = v_blocks[home]
            at = np.repeat(np.arange(len(ids)), reps)
            vblock = np.arange(len(at)) - np.repeat(np.cumsum(reps) - reps, reps)
            parts = [(at, home[at], my_block[at], vblock, np.where(vblock == 0, 0, 1) if self_join else np.ones(len(at), np.int64))]
            # visitors
            q = np.flatnonzero(asks)
            rows, leaves, _ = t.best_bin_first(x[q], t.theta)
            rows = q[rows]
            reps = m_blocks[leaves]
            r = np.repeat(rows, reps)
            leaf = np.repeat(leaves, reps)
            block = np.arange(len(r)) - np.repeat(np.cumsum(reps) - reps, reps)
            if self_join:  # a member meets its own block anyway, and of two blocks of its leaf one meets the other
                keep = (leaf != home[r]) | (block > my_block[r])
                r, leaf, block = r[keep], leaf[keep], block[keep]
            parts.append((r, leaf, block, (h[r] // 7919) % v_blocks[leaf], np.full(len(r), 2)))
            at, leaf, block, vblock, role = (np.concatenate(c) for c in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf, pa.int32()), pa.array(block, pa.int32()), pa.array(vblock, pa.int32()), pa.array(role, pa.int8()), pa.array(ids[at]), b["v"].take(pa.array(at))],
                names=["leaf", "mb", "vb", "role", "vec_id", "v"],
            )

    routed = vectors.mapInArrow(route, "leaf int, mb int, vb int, role byte, vec_id long, v binary")
    # several parts for each group: groups are few and large, so that hashing them into few parts would pile them up
    parts = int(min(20_000, max(spark.sparkContext.defaultParallelism, 4 * (mb * vb).sum())))
    return routed.repartition(parts, "leaf", "mb", "vb")


def _collect(a: np.ndarray, a_ids: np.ndarray, b: np.ndarray, b_ids: np.ndarray, k: int, min_sim: float, both: bool, out: list, upper: bool = False) -> None:
    """Adds (source, target, similarity) that hold for each row of ``a``, and with ``both`` of ``b``, its k best of the other side.

    ``upper``: ``b`` is ``a``; each pair is looked at once.
    """
    if len(a) == 0 or len(b) == 0:
        return
    step = max(1, CELLS // len(b))
    for s in range(0, len(a), step):
        low = s if upper else 0
        sims = a[s : s + step] @ b[low:].T
        if upper:
            sims[np.tril_indices(len(sims), 0, sims.shape[1])] = -2
        else:
            sims[a_ids[s : s + step, None] == b_ids[None, :]] = -2
        mask = sims >= max(min_sim, -1.5)
        if mask.sum() > 32 * len(sims):  # dense: only what can be among the k best of its row or column
            keep = sims >= _kth(sims, k, 1)
            if both:
                keep |= sims >= _kth(sims, k, 0)
            mask &= keep
        r, c = np.nonzero(mask)
        v = sims[r, c]
        src, dst = a_ids[s + r], b_ids[low + c]
        out.append((src, dst, v))
        if both:
            out.append((dst, src, v))


def _kth(sims: np.ndarray, k: int, axis: int) -> np.ndarray:
    kk = min(k, sims.shape[axis])
    return np.take(np.partition(sims, sims.shape[axis] - kk, axis=axis), [sims.shape[axis] - kk], axis=axis)


def _first_k(out: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    src, dst, v = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.lexsort((dst, -v, src))
    src, dst, v = src[order], dst[order], v[order]
    top = np.arange(len(src)) - np.searchsorted(src, src, "left") < k
    return src[top], dst[top], v[top]


def _compared(routed: DataFrame, k: int, min_sim: float, self_join: bool, dim: int) -> DataFrame:
    """(a, b, sim): per group the k best of each query that is there."""

    def compare(table: pa.Table) -> pa.Table:
        role = table["role"].to_numpy()
        ids = table["vec_id"].to_numpy()
        x = _from_binary(table["v"], dim)
        m, v = np.flatnonzero(role < 2), np.flatnonzero(role == 2)
        m, v = m[np.unique(ids[m], return_index=True)[1]], v[np.unique(ids[v], return_index=True)[1]]
        out: list = []
        if self_join and (role == 0).any():
            _collect(x[m], ids[m], x[m], ids[m], k, min_sim, True, out, upper=True)
        if len(v):
            _collect(x[v], ids[v], x[m], ids[m], k, min_sim, self_join, out)
        a, b, s = _first_k(out, k)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sim": pa.array(s.astype(np.float64))})

    return routed.groupBy("leaf", "mb", "vb").applyInArrow(compare, "a long, b long, sim double")


def _top(links: DataFrame, k: int) -> DataFrame:
    best = links.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _classes(vectors: DataFrame) -> DataFrame | None:
    """(vec_id, rep): ids of vectors that other ids have too, with the least id of the class; None if there are none. Only hashes are shuffled."""
    hashed = vectors.select("vec_id", F.xxhash64("v").alias("h"), F.hash("v").alias("g"))
    many = hashed.groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.max("vec_id").alias("high")).filter("rep <> high").select("h", "g", "rep")
    listed, n = _listed(materialise(many, "vector-classes"))
    if n == 0:
        return None
    return materialise(hashed.join(listed, ["h", "g"]).select("vec_id", "rep").distinct(), "vector-members")


def _for_members(links: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Links of representatives as links of all members of their classes: no link between texts is lost, and each member gets ``k`` at most."""
    order = Window.partitionBy("rep").orderBy("vec_id")
    head = materialise(members.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).select("rep", F.col("vec_id").alias("id")), "vector-heads")
    head, _ = _listed(head)  # k + 1 ids of a class at most
    wide = links.join(head.withColumnRenamed("rep", "b"), "b", "left").select("a", F.coalesce("id", "b").alias("b"), "sim")
    mates = head.select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("sim"))
    per_class = _top(wide.unionByName(mates), k + 1).drop("rank")
    own = members.select(F.col("rep").alias("a"), F.col("vec_id"))
    spread_out = per_class.join(own, "a", "left").select(F.coalesce("vec_id", "a").alias("a"), "b", "sim")
    return _top(spread_out.filter("a <> b"), k)


def neighbour_graph(vectors: DataFrame, k: int = 10, min_sim: float = -1.0, recall: float = 0.99, dim: int = 96, exact: bool = False) -> DataFrame:
    """(a, b, sim, rank): for every vector its k most similar others of at least ``min_sim``; ``exact``: against all vectors, in blocks."""
    vectors = settled(materialise(vectors, "vectors"))
    members = _classes(vectors)
    one = vectors
    if members is not None:
        copies, _ = _listed(materialise(members.filter("vec_id <> rep").select("vec_id"), "vector-copies"))
        one = vectors.join(copies, "vec_id", "left_anti")
    tree, n = (one_leaf(dim), one.count()) if exact else build(one, recall, k, min_sim, True, dim)
    links = _top(_compared(_route(one, tree, n, lambda ids: np.ones(len(ids), np.bool_), True, dim), k, min_sim, True, dim), k)
    return links if members is None else _for_members(links.drop("rank"), members, k)


def search(vectors: DataFrame, every: int = 100, k: int = 10, recall: float = 0.95, exact: bool = False, dim: int = 96) -> DataFrame:
    """(a, b, sim, rank): the k most similar vectors of every query, the vectors whose id is divisible by ``every``.

    ``exact``: against all vectors, in blocks; else through the tree.
    """
    vectors = settled(materialise(vectors, "vectors"))
    if exact:
        tree, n = one_leaf(dim, 1.0 / every), vectors.count()
    else:
        tree, n = build(vectors, recall, k, -1.0, False, dim)
        tree.visitors = tree.visitors / every
    routed = _route(vectors, tree, n, lambda ids: ids % every == 0, False, dim)
    return _top(_compared(routed, k, -1.0, False, dim), k)


def similar_pairs(vectors: DataFrame, k: int = 10, min_sim: float = 0.8, recall: float = 0.99, dim: int = 96, exact: bool = False) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b: pairs of at least ``min_sim`` of which one is among the other's k most similar."""
    links = neighbour_graph(vectors, k, min_sim, recall, dim, exact)
    return links.select(F.least("a", "b").alias("vec_a"), F.greatest("a", "b").alias("vec_b")).distinct()


def loss(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: neighbours that an exact search finds, how many of them the index found, and the recall."""
    hit = exact.select("a", "b").join(approximate.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left")
    out = hit.agg(F.count("*").alias("n_exact"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_found"))
    return out.withColumn("recall", F.round(F.col("n_found") / F.col("n_exact"), 6))
