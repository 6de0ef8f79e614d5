"""Approximate nearest neighbours by inner product: a forest of random-projection trees, exact reranking.

1. Equal vectors are one class with its smallest ids: no other of its rows can be among the nearest.
2. `TREES` trees are grown on at most `FIT_ROWS` classes that aren't queries, the first by a hash of their ids. A node sends a vector
   left or right by its projection on the difference of two random vectors of the node, cut at the median, down to `LEAF_ROWS` fitted
   rows. Where there are more rows than fitted ones, leaves are split on, one level for each doubling, by planes midway between two fitted
   vectors of the leaf, which a hash of the branch picks: those nodes are computed where they are needed and stored nowhere. So what is broadcast
   is bounded by FIT_ROWS, and leaves hold about LEAF_ROWS rows at every size.
3. The trees are in `GROUPS` groups; those of one group share their first levels, so that a vector is sent once for each group, to the bucket
   that these levels choose (of about `BUCKET_ROWS` vectors), and not once for each tree.
4. A branch's key is the sum over its cuts of minus the log-probability that a neighbour of the query is on that side, by how far from the cut
   the query is; the best first, branches would leave one priority queue in this order (`walks`). A query takes all leaves up to one key, which is
   calibrated: the least with which `CALIBRATED_ON` of the queries, held against all rows, find `RECALL` of their true nearest. Queries are
   never fitted, so this is a recall on unseen queries, at the size at hand.
5. A query is sent to each bucket whose shared levels leave its key below that, with its vector alone. The bucket's task goes down the trees with
   many queries at once, each branch with those that reach it, compares the members of a leaf with the queries there by one product of
   matrices, and keeps each query's best. The best over all buckets are ranked by inner product in double precision, then by id. A bucket
   of too many members is compared in parts.

Vectors that are null, empty or all zero, hold null or non-finite components, or have another length than most, take no
part; nor do null ids. Of an id that repeats, the smallest vector counts. A query without other vectors has no rows.
"""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops as T
from .common import saved, shuffle_partitions, table

K = 20
QUERY_EVERY = 20
TREES, GROUPS, LEAF_ROWS, FIT_ROWS = 32, 4, 32, 65536
BUCKET_ROWS, PART_ROWS = 65536, 65536
#: Queries that go down the trees of a bucket together; candidates held for each before all but its best are dropped.
QUERY_ROWS, HELD = 2048, 96
CALIBRATED_ON, RECALL = 128, 0.93

#: log of the normal distribution function at -8 to 8, in steps of 1 / 250.
_LOG_NORMAL = [math.log(max(0.5 * math.erfc(-z / 250 / math.sqrt(2)), 1e-15)) for z in range(-2000, 2001)]
_LOGS = np.array(_LOG_NORMAL)


def _number(*parts: int) -> int:
    """A 64-bit number that looks random and hangs on all parts."""
    x = 0
    for p in parts:
        x = (x ^ p) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 32
    return x


class Forest:
    """Nodes of all trees in common arrays: plane (of length 1), cut, deviation of the projections, children; a child below 0 is the leaf -1 - number.

    rows: how many there are to deal. A leaf goes on for `extra` levels of computed nodes; it is named by its number and the way below it.
    """

    def __init__(self, fitted: np.ndarray, rows: int, trees: int = TREES, groups: int = GROUPS):
        self.fitted = fitted.astype(np.float32)
        self.shared = max(0, math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS)))
        self.extra = max(0, math.ceil(math.log2(max(rows, 1) / max(len(fitted), 1)) - 0.25)) if len(fitted) else 0
        self.slope, self.bound = 1.0, math.inf
        self.roots: list[int] = []
        #: For each bucket, the branches that it begins with in the trees of its group; the bucket of each of these that is a node.
        self.begins: list[list[int]] = []
        self.bucket_of_node: dict[int, int] = {}
        self.groups, self.bucket_of, self.deviation_of, leaf_rows = groups, [], [], []
        planes, cuts, deviations, children = [], [], [], []
        buckets: dict[tuple, int] = {}
        repeated = [np.arange(LEAF_ROWS) % max(n, 1) for n in range(LEAF_ROWS + 1)]
        for tree in range(trees if len(fitted) else 0):
            group = tree % groups
            stack = [(np.arange(len(fitted)), 1, 0, None, 0, 1.0)]
            while stack:
                own, path, depth, parent, side, deviation = stack.pop()
                made = None
                for again in range(5 if len(own) > LEAF_ROWS else 0):
                    h = _number(group, path, again, 0 if depth < self.shared else tree + 1)
                    a, b = h % len(own), (h >> 32) % len(own)
                    plane = self.fitted[own[a]] - self.fitted[own[b]]
                    size = math.sqrt(plane @ plane)
                    if size > 0:
                        plane /= size
                        at = self.fitted[own] @ plane
                        middle = (len(at) - 1) // 2
                        cut = float(np.partition(at, middle)[middle])
                        right = at > cut
                        if right.any():
                            at -= cut
                            made = plane, cut, max(math.sqrt(max(at @ at / len(at) - (at.sum() / len(at)) ** 2, 0.0)), 1e-30), right
                            break
                if made:
                    here = len(planes)
                    if depth == self.shared:
                        self.bucket_of_node[here] = buckets.setdefault((group, path), len(buckets))
                    planes.append(made[0])
                    cuts.append(made[1])
                    deviations.append(made[2])
                    children.append([0, 0])
                    stack.append((own[made[3]], path * 2 + 1, depth + 1, here, 1, made[2]))
                    stack.append((own[~made[3]], path * 2, depth + 1, here, 0, made[2]))
                else:
                    here = -1 - len(self.bucket_of)
                    top = path >> (depth - self.shared) if depth > self.shared else path
                    self.bucket_of.append(buckets.setdefault((group, top), len(buckets)))
                    self.deviation_of.append(deviation)
                    leaf_rows.append(own[repeated[min(len(own), LEAF_ROWS)]])
                if parent is None:
                    self.roots.append(here)
                else:
                    children[parent][side] = here
        self.planes = np.array(planes, np.float32).reshape(len(planes), fitted.shape[1])
        self.cuts, self.deviations = np.array(cuts, np.float32), np.array(deviations, np.float32)
        self.children = np.array(children, np.int64).reshape(-1, 2)
        self.leaf_rows = np.array(leaf_rows, np.int32).reshape(-1, LEAF_ROWS)
        self.bucket_of = np.array(self.bucket_of, np.int64)
        self.begins = [[] for _ in buckets]
        for root in self.roots:
            level = [root]
            for _ in range(self.shared):
                level = [c for node in level for c in (children[node] if node >= 0 else [node])]
            for node in level:
                self.begins[self.bucket_of_node[node] if node >= 0 else self.bucket_of[-1 - node]].append(node)

    def below(self, leaf: np.ndarray, way: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Planes and cuts of computed nodes: midway between two fitted vectors of the leaf."""
        h = T.mix(leaf.astype(np.uint64) << np.uint64(20) ^ way.astype(np.uint64))
        a = self.fitted[self.leaf_rows[leaf, (h % np.uint64(LEAF_ROWS)).astype(np.int64)]]
        b = self.fitted[self.leaf_rows[leaf, (h >> np.uint64(32)).astype(np.int64) % LEAF_ROWS]]
        size = np.maximum(np.linalg.norm(a - b, axis=1), np.float32(1e-30))
        planes = (a - b) / size[:, None]
        return planes, np.einsum("ij,ij->i", planes, (a + b) / 2)

    def dealt(self, x: np.ndarray) -> np.ndarray:
        """The named leaf of each vector in each tree."""
        x = x.astype(np.float32)
        out = np.empty((len(x), len(self.roots)), dtype=np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while (open_ := at >= 0).any():
                i = np.flatnonzero(open_)
                n = at[i]
                at[i] = self.children[n, (np.einsum("ij,ij->i", x[i], self.planes[n]) > self.cuts[n]).astype(int)]
            leaf, way = -1 - at, np.ones(len(x), np.int64)
            for _ in range(self.extra):
                planes, cuts = self.below(leaf, way)
                way = way * 2 + (np.einsum("ij,ij->i", x, planes) > cuts)
            out[:, t] = (leaf << self.extra) + way - (1 << self.extra)
        return out

    def bucket(self, leaves: np.ndarray) -> np.ndarray:
        return self.bucket_of[leaves >> self.extra]

    def _steps(self, z: np.ndarray, deviation) -> np.ndarray:
        return (np.clip(np.nan_to_num(z * (self.slope * 250 / deviation)), -2000, 2000) + 2000).astype(np.int16)

    def keys_at(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """For each row, the least key over the trees of the leaf that x is in, to the query q."""
        q, x = q.astype(np.float32), x.astype(np.float32)
        least = np.full(len(q), np.inf)
        for root in self.roots:
            at, key = np.full(len(q), root), np.zeros(len(q))

            def cross(i, planes, cuts, deviations):
                right = np.einsum("ij,ij->i", x[i], planes) > cuts
                steps = self._steps(np.einsum("ij,ij->i", q[i], planes) - cuts, deviations)
                key[i] -= _LOGS[np.where(right, steps, 4000 - steps)]
                return right

            while len(i := np.flatnonzero(at >= 0)):
                n = at[i]
                at[i] = self.children[n, cross(i, self.planes[n], self.cuts[n], self.deviations[n]).astype(int)]
            leaf, way, every = -1 - at, np.ones(len(q), np.int64), np.arange(len(q))
            for _ in range(self.extra):
                way = way * 2 + cross(every, *self.below(leaf, way), np.array(self.deviation_of)[leaf])
            least = np.minimum(least, key)
        return least

    def reach(self, queries: np.ndarray, near: np.ndarray, of: np.ndarray, recall: float) -> None:
        """Sets the key up to which queries take leaves: the least with which these meet that share of their true neighbours: near, rows of vectors, of, the query of each."""
        if len(near) and len(self.roots):
            self._sloped(queries, near, of)
            keys = np.sort(self.keys_at(queries[of], near))
            self.bound = float(keys[math.ceil(recall * len(keys)) - 1]) + 1e-9

    def buckets_for(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row of q and a bucket that it is sent to."""
        q = q.astype(np.float32)
        rows, buckets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for root in self.roots[: self.groups]:  # the trees of a group share these levels
            stack = [(root, 0, np.arange(len(q)), np.zeros(len(q)))]
            while stack:
                node, depth, own, key = stack.pop()
                if node < 0 or depth == self.shared:
                    rows.append(own)
                    buckets.append(np.full(len(own), self.bucket_of_node[node] if node >= 0 else self.bucket_of[-1 - node]))
                    continue
                steps = self._steps(q[own] @ self.planes[node] - self.cuts[node], self.deviations[node])
                for child, side in zip(self.children[node].tolist(), (4000 - steps, steps), strict=True):
                    reached = key - _LOGS[side]
                    on = reached <= self.bound
                    if on.any():
                        stack.append((child, depth + 1, own[on], reached[on]))
        return np.concatenate(rows), np.concatenate(buckets)

    def local(self, bucket: int) -> Local:
        """The trees of a bucket in arrays of their own, computed nodes too."""
        nodes, children, leaves, computed = [], [], [], []
        begins = []

        def add(node: int, way: int, put) -> None:
            stack = [(node, way, put)]
            while stack:
                node, way, (into, side) = stack.pop()
                if node < 0 and way >> self.extra:
                    into[side] = -1 - len(leaves)
                    leaves.append((-1 - node << self.extra) + way - (1 << self.extra))
                    continue
                into[side] = len(nodes)
                own = [0, 0]
                children.append(own)
                if node >= 0:
                    nodes.append(node)
                    low, high = self._child_list[node]
                    stack += [(low, 1, (own, 0)), (high, 1, (own, 1))]
                else:
                    computed.append((len(nodes), -1 - node, way))
                    nodes.append(-1)
                    stack += [(node, way * 2, (own, 0)), (node, way * 2 + 1, (own, 1))]

        for node in self.begins[bucket]:
            place = [0]
            add(node, 1, (place, 0))
            begins.append(place[0])
        given = np.array(nodes, np.int64).reshape(-1)
        planes, cuts, deviations = np.zeros((len(given), self.fitted.shape[1]), np.float32), np.zeros(len(given), np.float32), np.ones(len(given))
        planes[given >= 0], cuts[given >= 0], deviations[given >= 0] = (a[given[given >= 0]] for a in (self.planes, self.cuts, self.deviations))
        if computed:
            at, leaf, way = np.array(computed).T
            planes[at], cuts[at] = self.below(leaf, way)
            deviations[at] = np.array(self.deviation_of)[leaf]
        # a bucket's part is one branch of a tree, so the key above it is that of the shared levels
        group = next(g for g, root in enumerate(self.roots[: self.groups]) if self._leads(root, self.begins[bucket][0]))
        return Local(self, self.roots[group], self.begins[bucket][0], begins, planes, cuts, deviations, children, np.array(leaves, np.int64))

    def _leads(self, root: int, node: int) -> bool:
        return bool(self._way(root, node))

    def _way(self, root: int, wanted: int) -> list[tuple[int, int]] | None:
        """The nodes and sides from a root to the branch that a bucket begins with, none if it isn't there. A way of no steps is [(-1, 0)]."""
        stack = [(root, 0, [(-1, 0)])]
        while stack:
            node, depth, way = stack.pop()
            if node == wanted:
                return way
            if node >= 0 and depth < self.shared:
                stack += [(c, depth + 1, [*way, (node, side)]) for side, c in enumerate(self._child_list[node])]
        return None

    def walks(self, q: np.ndarray, keys: bool = False):
        """For each query an iterator over named leaves, in the order of the shared priority queue; with keys=True over (key, leaf)."""
        q = q.astype(np.float32)
        for lo in range(0, len(q), 64):
            part = q[lo : lo + 64]
            z = (part @ self.planes.T - self.cuts) * (self.slope * 250 / self.deviations)
            steps = (np.clip(np.nan_to_num(z), -2000, 2000) + 2000).astype(np.int16)
            for i in range(len(part)):
                yield self._walk(part[i], memoryview(steps[i]), keys)

    def _walk(self, q: np.ndarray, steps: memoryview, keys: bool = False):
        """Named leaves, or with keys=True (key, leaf); keys are minus the log-probability. Branches past `bound` wait beside the queue until it is empty."""
        children, extra, table, bound, push = self._child_list, self.extra, _LOG_NORMAL, self.bound, heapq.heappush
        queue = [(0.0, i, root, 1) for i, root in enumerate(self.roots)]
        later: list[tuple] = []
        order = len(queue)
        while queue or later:
            if not queue:
                queue, later, bound = later, [], math.inf
                heapq.heapify(queue)
            far, _, node, way = heapq.heappop(queue)
            while node >= 0:
                step = steps[node]
                right, left = far - table[step], far - table[4000 - step]
                low, high = children[node]
                order += 1
                if right < left:
                    far, node, other, key = right, high, low, left
                else:
                    far, node, other, key = left, low, high, right
                if key <= bound:
                    push(queue, (key, order, other, 1))
                else:
                    later.append((key, order, other, 1))
            leaf = -1 - node
            while way >> extra == 0:
                plane, cut = self._below(leaf, way)
                z = (float(plane @ q) - cut) * self.slope * 250 / self.deviation_of[leaf]
                step = int(min(max(z, -2000), 2000)) + 2000
                right, left = far - table[step], far - table[4000 - step]
                side = right < left
                order += 1
                key = left if side else right
                if key <= bound:
                    push(queue, (key, order, node, way * 2 + 1 - side))
                else:
                    later.append((key, order, node, way * 2 + 1 - side))
                far, way = (right, way * 2 + 1) if side else (left, way * 2)
            named = (leaf << extra) + way - (1 << extra)
            yield (far, named) if keys else named

    def _below(self, leaf: int, way: int) -> tuple[np.ndarray, float]:
        """One computed node; those last used are kept."""
        if "_made" not in self.__dict__ or len(self._made) > 100_000:
            self._made: dict = {}
        found = self._made.get((leaf, way))
        if found is None:
            planes, cuts = self.below(np.array([leaf]), np.array([way]))
            found = self._made[leaf, way] = planes[0], float(cuts[0])
        return found

    @property
    def _child_list(self) -> list:
        if "_children" not in self.__dict__:
            self._children = self.children.tolist()
        return self._children

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_children", "_made")}

    def _sloped(self, queries: np.ndarray, near: np.ndarray, of: np.ndarray) -> None:
        nodes = np.linspace(0, len(self.planes) - 1, min(512, len(self.planes))).astype(int)
        if len(nodes):
            own, others = queries.astype(np.float32) @ self.planes[nodes].T, near.astype(np.float32) @ self.planes[nodes].T
            r = float(np.corrcoef(own[of].ravel(), others.ravel())[0, 1]) if len(of) > 2 else 0.5
            self.slope = min(max(r if r == r else 0.5, 0.2) / math.sqrt(max(1 - r * r, 0.01)), 6.0)

    def calibrated(self, queries: np.ndarray, near: np.ndarray, of: np.ndarray, recall: float) -> int:
        """The fewest leaves with which the queries meet that share of their true neighbours: near, rows of vectors, of, the query of each."""
        if not len(near) or not len(self.roots):
            return len(self.bucket_of) << self.extra
        self._sloped(queries, near, of)
        met: list[dict] = [{} for _ in queries]  # named leaf: the neighbours there that no leaf before held
        for at, (j, leaves) in enumerate(zip(of.tolist(), self.dealt(near).tolist(), strict=True)):
            for leaf in leaves:
                met[j].setdefault(leaf, []).append(at)
        walks = list(self.walks(queries, keys=True))
        place = np.full(len(near), np.iinfo(np.int64).max)
        farthest: list[list[float]] = [[] for _ in queries]
        done, goal, wanted = 0, 64, math.ceil(recall * len(near))
        while True:
            ended = True
            for walk, own, far in zip(walks, met, farthest, strict=True):
                for i, (key, leaf) in enumerate(itertools.islice(walk, goal - done)):
                    ended = False
                    far.append(key)
                    for at in own.get(leaf, ()):
                        place[at] = min(place[at], done + i)
            done = goal
            if ended or (place < done).sum() >= wanted:
                most = int(np.sort(place)[wanted - 1]) + 1 if (place < done).sum() >= wanted else done
                self.bound = max((far[min(most, len(far)) - 1] for far in farthest if far), default=math.inf)
                return most
            goal *= 2


class Local:
    """The trees below one bucket, gone down by many queries at once."""

    def __init__(self, forest: Forest, root: int, first: int, begins, planes, cuts, deviations, children, leaves):
        self.forest, self.begins, self.planes, self.cuts, self.deviations, self.children, self.leaves = forest, begins, planes, cuts, deviations, children, leaves
        self.way = forest._way(root, first)[1:]

    def taken(self, q: np.ndarray):
        """(leaf, rows of q that take it) of all leaves that any takes."""
        q, forest = q.astype(np.float32), self.forest
        above = np.zeros(len(q))
        for node, side in self.way:
            steps = forest._steps(q @ forest.planes[node] - forest.cuts[node], forest.deviations[node])
            above -= _LOGS[steps if side else 4000 - steps]
        steps = np.empty((len(self.planes), len(q)), np.int16)
        for lo in range(0, len(steps), 1024):
            part = slice(lo, lo + 1024)
            steps[part] = forest._steps(self.planes[part] @ q.T - self.cuts[part, None], self.deviations[part, None])
        for begin in self.begins:
            stack = [(begin, np.arange(len(q)), above)]
            while stack:
                node, own, key = stack.pop()
                if node < 0:
                    yield self.leaves[-1 - node], own
                    continue
                step = steps[node, own]
                for child, side in zip(self.children[node], (4000 - step, step), strict=True):
                    reached = key - _LOGS[side]
                    on = np.flatnonzero(reached <= forest.bound)
                    if len(on):
                        stack.append((child, own[on], reached[on]))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class _Members:
    """The members of a bucket's part by leaf, and the best of them for queries."""

    def __init__(self, held: list, local: Local, most: int):
        self.ids, self.vectors, leaves = (np.concatenate(x) for x in zip(*held, strict=True))
        self.local, self.most = local, most
        order = np.argsort(leaves.ravel(), kind="stable")
        self.named, self.rows = leaves.ravel()[order], order // leaves.shape[1]
        sizes = np.linalg.norm(self.vectors, axis=1)
        self.largest = float(sizes.max())
        self.rough = self.vectors.astype(np.float32) if sizes.max() < 1e15 and sizes.min() > 1e-15 else self.vectors

    def best(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of queries, id, score) of the best members in the leaves that each takes."""
        q = queries.astype(self.rough.dtype)
        slack = (2e-5 * self.largest * np.linalg.norm(queries, axis=1)).astype(self.rough.dtype)
        least = np.full(len(q), -np.inf, self.rough.dtype)
        held, size = [], 0

        def kept():
            """Those held, each once, that can still be among the best; what is to be reached rises."""
            of, rows, near = (np.concatenate(x) for x in zip(*held, strict=True))
            _, once = np.unique(of * len(self.ids) + rows, return_index=True)
            of, rows, near = of[once], rows[once], near[once]
            order = np.lexsort((-near, of))
            of, rows, near = of[order], rows[order], near[order]
            first = np.searchsorted(of, np.arange(len(q)))
            full = np.flatnonzero(np.diff(np.append(first, len(of))) >= self.most)
            least[full] = np.maximum(least[full], near[first[full] + self.most - 1] - slack[full])
            on = near >= least[of]
            return [(of[on], rows[on], near[on])]

        for leaf, own in self.local.taken(queries):
            lo, hi = np.searchsorted(self.named, (leaf, leaf + 1)).tolist()
            for s in range(lo, hi, 8192):  # a leaf of copies, or one that no plane splits
                rows = self.rows[s : min(hi, s + 8192)]
                near = q[own] @ self.rough[rows].T
                i, j = np.nonzero(near >= least[own, None])
                held.append((own[i], rows[j], near[i, j]))
                size += len(i)
                if size > HELD * len(q):
                    held = kept()
                    size = min(len(held[0][0]), HELD * len(q) // 2)
        if not held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        of, rows, _ = kept()[0]
        exact = (self.vectors[rows] * queries[of]).sum(axis=1)
        ids = self.ids[rows]
        order = np.lexsort((ids, -exact, of))
        of, ids, exact = of[order], ids[order], exact[order]
        on = np.arange(len(of)) - np.searchsorted(of, of) < self.most
        return of[on], ids[on], exact[on]


def _compared(most: int, shared):
    """Streams rows sorted by (bucket, part, is query): members with their leaves, then queries; keeps each query's best."""
    names = ["query", "cid", "score"]

    def run(batches):
        key, held, members = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, part, kind, ids = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("bucket", "part", "kind", "id"))
            vectors = _matrix(batch.column("v"))
            leaves = batch.column("leaves")
            named, bounds = leaves.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(pa.compute.list_value_length(leaves).fill_null(0).to_numpy(zero_copy_only=False))))
            cut = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]))))
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)], strict=True):
                if (bucket[s], part[s]) != key:
                    key, held, members = (bucket[s], part[s]), [], None
                m = s + int((kind[s:e] == 0).sum())
                if m > s:
                    held.append((ids[s:m].copy(), vectors[s:m].copy(), named[bounds[s] : bounds[m]].reshape(m - s, -1).copy()))
                if m < e and held:  # members come first, so queries can be done with as they come
                    members = members or _Members(held, shared.value.local(int(key[0])), most)
                    for lo in range(m, e, QUERY_ROWS):
                        hi = min(e, lo + QUERY_ROWS)
                        of, found, scores = members.best(vectors[lo:hi])
                        yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][of]), pa.array(found), pa.array(scores)], names=names)

    return run


def _exact(ids: np.ndarray, queries: np.ndarray, k: int):
    """Streams classes against some queries: the k nearest others of each, in this task."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own, x = batch.column("cid").to_numpy(), _matrix(batch.column("v"))
            near = queries @ x.T
            near[ids[:, None] == own[None, :]] = -np.inf
            at = np.argpartition(-near, min(k, near.shape[1]) - 1, axis=1)[:, :k]
            i, j = np.repeat(np.arange(len(ids)), at.shape[1]), at.ravel()
            ok = np.isfinite(near[i, j])
            i, j = i[ok], j[ok]
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(own[j]), pa.array(near[i, j]), batch.column("v").take(pa.array(j))], names=["of", "cid", "score", "v"])

    return run


def forest_of(classes: DataFrame, asked: DataFrame, k: int = K, recall: float = RECALL) -> Forest:
    """The forest of classes(cid, v), calibrated; asked(cid, v): the queries, of which none is fitted."""
    own = asked.select("cid").distinct()
    fit = classes.join(own, "cid", "left_anti").orderBy(F.xxhash64("cid"), "cid").limit(FIT_ROWS).select("cid", "v").toArrow()
    if fit.num_rows < LEAF_ROWS:  # nearly all are queries: a tree of one leaf, or of those
        fit = classes.orderBy(F.xxhash64("cid"), "cid").limit(FIT_ROWS).select("cid", "v").toArrow()
    fitted = _matrix(fit["v"].combine_chunks()) if fit.num_rows else np.zeros((0, 1))
    if fit.num_rows:
        fitted = fitted[np.argsort(fit["cid"].to_numpy(), kind="stable")]
    forest = Forest(fitted, classes.count())
    tried = asked.dropDuplicates(["cid"]).orderBy(F.xxhash64("cid", F.lit(1)), "cid").limit(CALIBRATED_ON).select("cid", "v").toArrow()
    if not tried.num_rows or not fit.num_rows:
        return forest
    queries = _matrix(tried["v"].combine_chunks())
    near = classes.select("cid", "v").mapInArrow(_exact(tried["cid"].to_numpy(), queries, k), f"of long, cid long, score double, v {classes.schema['v'].dataType.simpleString()}")
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("of").orderBy(F.desc("score"), "cid"))).where(F.col("nth") <= k).select("of", "v").toArrow()
    if near.num_rows:
        forest.reach(queries, _matrix(near["v"].combine_chunks()), near["of"].to_numpy(), recall)
    return forest


def nearest(vectors: DataFrame, queries_where: str, k: int = K, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of vectors(vec_id, embedding) for which the condition on vec_id holds."""
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    doubles = F.col("embedding") if single else F.transform("embedding", lambda x: x.cast("double"))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.withColumn("v", doubles).where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    lengths = rows.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n"))
    usual = lengths.agg(F.max_by("length", F.struct("n", -F.col("length")))).first()[0] or 0
    rows = rows.where(F.size("v") == usual).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("h", F.xxhash64("v"))
    rows = saved(rows)
    # the row_number limit is applied before the shuffle too, so a vector of very many copies sends few rows
    firsts = rows.withColumn("nth", F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    classes = saved(firsts.groupBy("h", "v").agg(F.min("vec_id").alias("cid"), F.array_sort(F.collect_list("vec_id")).alias("ids")))
    asked = rows.where(queries_where).select("vec_id", "h", "v").join(classes.select("h", "v", "cid"), ["h", "v"]).select("vec_id", "cid", "v")
    asked = saved(asked)
    forest = forest_of(classes, asked, k, recall)
    shared = spark.sparkContext.broadcast(forest)  # FIT_ROWS and TREES bound it
    kind = classes.schema["v"].dataType.simpleString()

    def rows_of(ids, vectors, buckets, of, leaves):
        return pa.RecordBatch.from_arrays([pa.array(buckets), ids.take(pa.array(of)), vectors.take(pa.array(of)), leaves], names=["bucket", "id", "v", "leaves"])

    def deal(batches):
        for batch in batches:
            forest = shared.value
            if batch.num_rows and forest.roots:
                leaves = forest.dealt(_matrix(batch.column("v")))
                for group in range(forest.groups):
                    own = np.ascontiguousarray(leaves[:, group :: forest.groups])
                    named = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, own.shape[1], dtype=np.int32)), pa.array(own.ravel()))
                    yield rows_of(batch.column("cid"), batch.column("v"), forest.bucket(own[:, 0]), np.arange(len(own)), named)

    def search(batches):
        for batch in batches:
            forest = shared.value
            if batch.num_rows and forest.roots:
                for lo in range(0, batch.num_rows, QUERY_ROWS):  # a query comes back once for each bucket
                    part = batch.slice(lo, QUERY_ROWS)
                    of, buckets = forest.buckets_for(_matrix(part.column("v")))
                    yield rows_of(part.column("cid"), part.column("v"), buckets, of, pa.nulls(len(of), pa.list_(pa.int64())))

    sent = f"bucket long, id long, v {kind}, leaves array<long>"
    dealt = saved(classes.select("cid", "v").mapInArrow(deal, sent))
    parts = dealt.groupBy("bucket").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts"))  # a row for each bucket
    members = dealt.join(parts, "bucket").select("bucket", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), F.lit(0).alias("kind"), "id", "v", "leaves")
    # dealt to a fixed number of tasks: few bytes, much work
    probes = asked.repartition(shuffle_partitions(spark), "cid").dropDuplicates(["cid"]).select("cid", "v").mapInArrow(search, sent)
    probes = probes.join(parts, "bucket").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "id", "v", "leaves")
    by = ["bucket", "part"]
    met = members.unionByName(probes).repartition(shuffle_partitions(spark), *by).sortWithinPartitions(*by, "kind").mapInArrow(_compared(k + 1, shared), "query long, cid long, score double")
    met = met.groupBy("query", "cid").agg(F.max("score").alias("score"))
    best = met.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cid"))).where(F.col("nth") <= k + 1)
    best = best.join(classes.select("cid", "ids"), "cid").select("query", "score", F.explode("ids").alias("vec_id"))
    one = best.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k + 1).alias("best"))  # (k + 1)^2 at most
    out = asked.select(F.col("vec_id").alias("query_id"), F.col("cid").alias("query")).join(one, "query")
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return out.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.minus")).alias("score"))


def op9_projection_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score of the 20 nearest found of each vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), f"vec_id % {QUERY_EVERY} = 0")
