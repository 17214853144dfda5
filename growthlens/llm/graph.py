"""A robust-pruned directed graph over unit vectors (one shard), in numpy.

Nodes enter in batches of a fixed random order.  A greedy beam search on the graph so far proposes a node's
neighbours, relaxed distance pruning keeps diverse ones: going from the nearest outwards, a kept neighbour k removes
every farther candidate c with ``RELAX * distance(k, c) <= distance(node, c)``.  The kept nodes get an edge back, and
are pruned again where they have more than DEGREE.  All nodes of a batch are searched and pruned at once, as arrays.
"""

from __future__ import annotations

import numpy as np

DEGREE = 32
#: Beam width while building.
BEAM = 48
RELAX = 1.2
#: Searches begin at this many nodes that lie far apart, so that a crowd of near copies does not hold them.
ENTRIES = 32
_BLOCK = 512


def entries(x: np.ndarray) -> np.ndarray:
    """ENTRIES nodes (fewer only of fewer nodes), each the farthest from those before it."""
    out, far = [int(np.argmin(x @ x.mean(axis=0)))] if len(x) else [], np.full(len(x), np.inf)
    while 0 < len(out) < min(ENTRIES, len(x)):
        far = np.minimum(far, 2 - 2 * (x @ x[out[-1]]))
        far[out] = -1
        out.append(int(far.argmax()))
    return np.array(out, dtype=np.int32)


def beam_search(x: np.ndarray, edges: np.ndarray, starts: np.ndarray, queries: np.ndarray, width: int):
    """Nodes and squared distances of the ``width`` nearest found from ``starts``, nearest first; none: -1 and inf.

    ``edges`` has a row of neighbours for each node, filled up with -1; ``starts`` are at most ``width`` nodes.
    """
    n = len(queries)
    ids = np.full((n, width), -1, dtype=np.int32)
    far = np.full((n, width), np.inf, dtype=np.float32)
    done = np.zeros((n, width), dtype=bool)
    seen = np.zeros((n, len(x)), dtype=bool)
    seen[:, starts] = True
    first = 2 - 2 * (queries @ x[starts].T)
    order = np.argsort(first, axis=1, kind="stable")
    ids[:, :len(starts)], far[:, :len(starts)] = starts[order], np.take_along_axis(first, order, axis=1)
    live = np.arange(n)
    while len(live):
        open_ = ~done[live] & (ids[live] >= 0)
        at = open_.argmax(axis=1)
        more = open_[np.arange(len(live)), at]
        live, at = live[more], at[more]
        if not len(live):
            break
        done[live, at] = True
        near = edges[ids[live, at]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        row, column = np.nonzero(fresh)
        if not len(row):
            continue
        node = near[row, column]
        seen[live[row], node] = True
        gap = np.full(near.shape, np.inf, dtype=np.float32)
        gap[row, column] = 2 - 2 * np.einsum("ij,ij->i", x[node], queries[live[row]])
        better = (gap < far[live, -1:]).any(axis=1)
        if not better.any():
            continue
        live_, near, gap = live[better], near[better], gap[better]
        all_far = np.concatenate([far[live_], gap], axis=1)
        all_ids = np.concatenate([ids[live_], np.where(np.isinf(gap), -1, near)], axis=1)
        all_done = np.concatenate([done[live_], np.zeros(gap.shape, dtype=bool)], axis=1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :width]
        far[live_] = np.take_along_axis(all_far, order, axis=1)
        ids[live_] = np.take_along_axis(all_ids, order, axis=1)
        done[live_] = np.take_along_axis(all_done, order, axis=1)
    return ids, far


def prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """At most DEGREE diverse neighbours of each node out of its row of candidates (-1: none), nearest first."""
    out = np.full((len(nodes), DEGREE), -1, dtype=np.int32)
    for a in range(0, len(nodes), _BLOCK):
        own, asked = nodes[a:a + _BLOCK], candidates[a:a + _BLOCK]
        asked = np.sort(asked, axis=1)
        none = (asked < 0) | (asked == own[:, None])
        none[:, 1:] |= asked[:, 1:] == asked[:, :-1]
        points = x[asked]
        far = 2 - 2 * np.einsum("ijk,ik->ij", points, x[own])
        far[none] = np.inf
        order = np.argsort(far, axis=1, kind="stable")
        far, asked = np.take_along_axis(far, order, axis=1), np.take_along_axis(asked, order, axis=1)
        points = np.take_along_axis(points, order[:, :, None], axis=1)
        between = np.maximum(2 - 2 * (points @ points.transpose(0, 2, 1)), 0)
        alive, rows = np.isfinite(far), np.arange(len(own))
        count = np.zeros(len(own), dtype=np.int64)
        for _ in range(DEGREE):
            at = alive.argmax(axis=1)
            some = alive[rows, at]
            if not some.any():
                break
            r, c = rows[some], at[some]
            out[a + r, count[some]] = asked[r, c]
            count[some] += 1
            alive[r] &= RELAX ** 2 * between[r, c] > far[r]
            alive[r, c] = False
    return out


def _with_back_edges(x: np.ndarray, edges: np.ndarray, batch: np.ndarray) -> None:
    """Adds an edge back from every neighbour of the batch's nodes; over DEGREE, the neighbour is pruned anew."""
    own = np.repeat(batch, DEGREE)
    to = edges[batch].ravel()
    own, to = own[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    own, to = own[order], to[order]
    nodes, first, counts = np.unique(to, return_index=True, return_counts=True)
    nth = np.arange(len(to)) - np.repeat(first, counts)
    added = np.full((len(nodes), int(counts.max()) if len(counts) else 0), -1, dtype=np.int32)
    added[np.repeat(np.arange(len(nodes)), counts), nth] = own
    for k in range(0, len(nodes), _BLOCK):
        part = nodes[k:k + _BLOCK]
        both = np.concatenate([edges[part], added[k:k + _BLOCK]], axis=1)
        both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
        sizes = (both >= 0).sum(axis=1)
        small = sizes <= DEGREE
        edges[part[small]] = both[small, :DEGREE]
        if not small.all():
            edges[part[~small]] = prune(x, part[~small], both[~small, :sizes.max()])


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a row a node, -1 where there are fewer) and the entry nodes of the graph over the unit vectors ``x``."""
    edges, starts = np.full((len(x), DEGREE), -1, dtype=np.int32), entries(x)
    order = np.concatenate([starts, np.setdiff1d(np.arange(len(x)), starts)]).astype(np.int32)
    np.random.default_rng(11).shuffle(order[len(starts):])
    done = 0
    while done < len(order):
        batch = order[done:done + min(max(len(starts), done), _BLOCK)]
        found, _ = beam_search(x, edges, starts, x[batch], BEAM)
        edges[batch] = prune(x, batch, found)
        _with_back_edges(x, edges, batch)
        done += len(batch)
    return edges, starts
