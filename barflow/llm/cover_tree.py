"""Cover trees for inner-product search, held as flat arrays, and best-first search of many queries at once.

Candidates are norm-augmented: sqrt(M^2 - |x|^2) is appended, M being the largest norm, so all lie on a sphere and an inner
product with (q, 0) falls with the distance to it.  A node covers its points by the greatest distance from its centre,
taken level by level; a node's children have centres of its own points that are further apart than half its radius
(at most ``FAN`` of them), the first being its own centre.  Points of at most ``LEAF`` or of no extent are a leaf.

For a query q, a node's points have inner products within q.c +- |q| r (plain radius), and within |q| M cos(angle(q, c) +- rho)
(rho: angular radius on the sphere); the tighter bound counts.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

LEAF = 32
FAN = 16
#: Room for rounding in bounds, as a share of |q| M; leaves are verified exactly.
SLACK = 1e-9


@dataclass
class Tree:
    """Points in leaf order, and nodes in order of creation, a node's children being neighbours."""

    x: np.ndarray        # points x d, whole numbers as float64
    ids: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    centre: np.ndarray   # node: index of its centre among the points
    plain: np.ndarray    # node: covering radius of the points
    angle: np.ndarray    # node: covering angle on the sphere
    begin: np.ndarray    # node: range of points, leaf or not
    end: np.ndarray
    child: np.ndarray    # node: first child, 0 for a leaf
    children: np.ndarray
    norm: np.ndarray     # one entry: M

    def packed(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, f.name)).tobytes() for f in fields(self)]


FIELDS = [f.name for f in fields(Tree)]
_TYPES = {"x": np.float64, "plain": np.float64, "angle": np.float64, "norm": np.float64}


def unpacked(parts: list[bytes]) -> Tree:
    arrays = {name: np.frombuffer(p, _TYPES.get(name, np.int64)) for name, p in zip(FIELDS, parts)}
    arrays["x"] = arrays["x"].reshape(len(arrays["ids"]), -1)
    return Tree(**arrays)


def build(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> Tree:
    """Cover tree of the points of one block."""
    square = (x * x).sum(1)
    norm = float(np.sqrt(square.max()))
    z = np.concatenate((x, np.sqrt(np.maximum(norm * norm - square, 0))[:, None]), 1)

    def away(members: np.ndarray, centre: int) -> np.ndarray:
        diff = z[members] - z[centre]
        return np.sqrt((diff * diff).sum(1))

    order = np.arange(len(x))
    nodes = [[int(np.argmin(((z - z.mean(0)) ** 2).sum(1))), 0, len(x), 0, 0]]
    radius = []
    at = 0
    while at < len(nodes):
        centre, lo, hi, _, _ = nodes[at]
        members = order[lo:hi]
        d = away(members, centre)
        radius.append((float(np.sqrt(((x[members] - x[centre]) ** 2).sum(1).max())), float(d.max())))
        if hi - lo > leaf and radius[-1][1] > 0:
            owner, reach, centres = np.zeros(hi - lo, np.int64), d, [centre]
            while len(centres) < fan and reach.max() > radius[-1][1] / 2 or len(centres) == 1:
                centres.append(int(members[np.argmax(reach)]))
                other = away(members, centres[-1])
                owner = np.where(other < reach, len(centres) - 1, owner)
                reach = np.minimum(other, reach)
            sort = np.argsort(owner, kind="stable")
            order[lo:hi] = members[sort]
            cut = lo + np.searchsorted(owner[sort], np.arange(len(centres) + 1))
            nodes[at][3], nodes[at][4] = len(nodes), len(centres)
            nodes += [[c, int(a), int(b), 0, 0] for c, a, b in zip(centres, cut[:-1], cut[1:])]
        at += 1
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    t = np.array(nodes, np.int64)
    plain, chord = np.array(radius).T
    angle = 2 * np.arcsin(np.minimum(chord / (2 * norm), 1)) if norm else np.zeros(len(t))
    return Tree(x[order], ids[order], rows[order], labels[order], place[t[:, 0]], plain, angle, t[:, 1], t[:, 2], t[:, 3], t[:, 4], np.array([norm]))


class Best:
    """The first ``k`` candidates of each query so far: higher scores first, ties by smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.scores = np.full((queries, k), np.iinfo(np.int64).min, np.int64)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max, np.int64)

    @property
    def last(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> None:
        """Merge candidates: a row of ``scores`` for each query, ids of the columns, and which of them count."""
        ok = ok & (scores >= self.last[queries][:, None])
        some = ok.any(1)
        if not some.any():
            return
        queries, ok = queries[some], ok[some]
        s = np.concatenate((self.scores[queries], np.where(ok, scores[some], np.iinfo(np.int64).min)), 1)
        i = np.concatenate((self.ids[queries], np.where(ok, ids[None, :], np.iinfo(np.int64).max)), 1)
        first = np.lexsort((i, -1 - s), axis=1)[:, :self.k]  # -1 - s falls with s and cannot overflow
        self.scores[queries] = np.take_along_axis(s, first, 1)
        self.ids[queries] = np.take_along_axis(i, first, 1)


@dataclass
class Queries:
    """Vectors with their own row and label, the window of scores wanted, and whether partners share the label."""

    x: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles where those are exact, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a @ b.T).astype(np.int64) if most < 1 << 53 else a.astype(np.int64) @ b.astype(np.int64).T


def search(tree: Tree, q: Queries, best: Best) -> int:
    """Add the tree's candidates to ``best``; returns how many points were verified.

    In each round every query takes its open node of the highest bound, while that can still hold a better candidate.
    """
    n, nodes = len(q.x), len(tree.centre)
    long = np.sqrt((q.x * q.x).sum(1))
    centres = tree.x[tree.centre]
    dot, size = q.x @ centres.T, np.sqrt((centres * centres).sum(1))
    sphere = (long * tree.norm[0])[:, None]
    theta = np.arccos(np.clip(np.divide(dot, sphere, out=np.zeros_like(dot), where=sphere > 0), -1, 1))
    slack = SLACK * (sphere + long[:, None] * size) + 1e-6
    upper = np.minimum(dot + long[:, None] * tree.plain, sphere * np.cos(np.maximum(theta - tree.angle, 0))) + slack
    lower = np.maximum(dot - long[:, None] * tree.plain, sphere * np.cos(np.minimum(theta + tree.angle, np.pi))) - slack
    kinds, label = np.unique(tree.labels, return_inverse=True)
    holds = np.zeros((nodes, len(kinds)), bool)
    for k in range(len(kinds)):
        ahead = np.append(0, np.cumsum(label == k))
        holds[:, k] = ahead[tree.end] > ahead[tree.begin]
    own = np.searchsorted(kinds, q.labels)
    known = (own < len(kinds)) & (kinds[np.minimum(own, len(kinds) - 1)] == q.labels)
    with_own = holds[:, np.where(known, own, 0)].T & known[:, None]
    only_own = with_own & (holds.sum(1) == 1)
    useful = (with_own if q.same else ~only_own) & (upper >= q.low[:, None]) & (lower <= q.high[:, None])
    bound = np.where(useful, np.minimum(upper, q.high[:, None]), -np.inf)
    opened = np.full((n, nodes), -np.inf)
    opened[:, 0] = bound[:, 0]
    verified, everyone = 0, np.arange(n)
    while True:
        at = opened.argmax(1)
        on = everyone[(opened[everyone, at] > -np.inf) & (opened[everyone, at] >= best.last)]
        if not len(on):
            return verified
        at = at[on]
        opened[on, at] = -np.inf
        sort = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(at[sort]) > 0))
        for part in np.split(sort, cuts[1:]):
            node, who = int(at[part[0]]), on[part]
            if tree.children[node]:
                c = slice(int(tree.child[node]), int(tree.child[node] + tree.children[node]))
                opened[who, c] = bound[who, c]
                continue
            lo, hi = int(tree.begin[node]), int(tree.end[node])
            score = products(q.x[who], tree.x[lo:hi])
            match = tree.labels[lo:hi][None, :] == q.labels[who][:, None]
            ok = (match if q.same else ~match) & (score >= q.low[who][:, None]) & (score <= q.high[who][:, None]) & (tree.rows[lo:hi][None, :] != q.rows[who][:, None])
            verified += score.size
            best.add(who, score, tree.ids[lo:hi], ok)
