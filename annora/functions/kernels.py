"""NumPy kernels: sign codes, pruning, graph building, beam search. Each works on one shard, whose size is bounded."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def encode(vectors: np.ndarray, centroid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign codes, squared norms and L1 norms of the centred rows."""
    c = vectors.astype(np.float64) - centroid.astype(np.float64)
    return np.packbits(c >= 0, axis=1, bitorder="little"), (c * c).sum(1), np.abs(c).sum(1)


def signs(codes: np.ndarray, dim: int) -> np.ndarray:
    return np.unpackbits(codes, axis=1, count=dim, bitorder="little").astype(np.float64) * 2 - 1


def estimates(query: np.ndarray, centroid: np.ndarray, sign: np.ndarray, sq: np.ndarray, l1: np.ndarray) -> np.ndarray:
    q = query.astype(np.float64) - centroid.astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = q @ q + sq - 2 * sq * (sign @ q) / l1
    return np.where(l1 == 0, sq, d)


def l2_to(vector: np.ndarray, rows: np.ndarray) -> np.ndarray:
    d = rows.astype(np.float64) - vector.astype(np.float64)
    return np.einsum("ij,ij->i", d, d)


def robust_prune(node: int, candidates: np.ndarray, vectors: np.ndarray, alpha: float, degree: int) -> list[int]:
    """At most degree neighbours, nearest first; one is passed over if a chosen one is nearer to it by the factor alpha."""
    left = np.unique(candidates)
    left = left[left != node]
    own = l2_to(vectors[node], vectors[left])
    order = np.lexsort((left, own))
    left, own = left[order], own[order]
    chosen: list[int] = []
    while len(left) and len(chosen) < degree:
        chosen.append(int(left[0]))
        keep = alpha * l2_to(vectors[left[0]], vectors[left]) > own
        keep[0] = False
        left, own = left[keep], own[keep]
    return chosen


#: Candidates that pruning takes at a time: which of them one rules out are the bits of a number.
TIER = 64


def _bits(flags: np.ndarray) -> np.ndarray:
    """TIER flags at most of the last axis as a number."""
    packed = np.zeros((*flags.shape[:-1], TIER // 8), np.uint8)
    some = np.packbits(flags, axis=-1, bitorder="little")
    packed[..., : some.shape[-1]] = some
    return packed.view("<u8")[..., 0]


def prune_many(nodes: np.ndarray, pools: list[np.ndarray], vectors: np.ndarray, alpha: float, degree: int, block: int = 64) -> list[list[int]]:
    """robust_prune() of many nodes, each with its pool, a block of nodes at a time; large pools, whose mutual distances would take much room, one by one.

    Distances are those of differences from the node, so that they are as exact as the node's own, in the vectors' precision.
    """
    out: list[list[int]] = [[] for _ in pools]
    sizes = np.array([len(p) for p in pools], np.int64)
    for which in np.flatnonzero(sizes > 8 * degree).tolist():
        out[which] = robust_prune(int(nodes[which]), pools[which], vectors, alpha, degree)
    by_size = np.argsort(sizes, kind="stable")
    by_size = by_size[sizes[by_size] <= 8 * degree]
    for at in range(0, len(by_size), block):
        part = by_size[at : at + block]
        size = sizes[part]
        if not size[-1]:
            continue
        cand = np.full((len(part), size[-1]), -1, np.int64)
        cand[np.arange(size[-1]) < size[:, None]] = np.concatenate([pools[which] for which in part.tolist()])
        cand.sort(axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        cand[cand == nodes[part][:, None]] = -1
        diff = vectors[cand]
        diff -= vectors[nodes[part]][:, None]
        own = np.einsum("ijk,ijk->ij", diff, diff)
        own[cand < 0] = np.inf
        order = np.argsort(own, axis=1, kind="stable")[:, : max(1, (cand >= 0).sum(1).max())]
        picked, count = np.full((len(part), degree), -1, np.int64), np.zeros(len(part), np.int64)  # places in cand
        # Nearest first, TIER at a time: what is far is mostly ruled out by what was chosen before it.
        for low in range(0, order.shape[1], TIER):
            rows = np.flatnonzero(count < degree)
            if not len(rows):
                break
            place = order[rows, low : low + TIER]
            x, far, alive = diff[rows[:, None], place], own[rows[:, None], place], cand[rows[:, None], place] >= 0
            if low:
                was = picked[rows, : max(1, count[rows].max())]
                apart = own[rows[:, None], was][:, :, None] + far[:, None] - 2 * diff[rows[:, None], was] @ x.transpose(0, 2, 1)
                alive &= ((alpha * apart > far[:, None]) | (was < 0)[:, :, None]).all(1)
            with np.errstate(invalid="ignore"):
                ruled = _bits(~(alpha * (far[:, :, None] + far[:, None] - 2 * x @ x.transpose(0, 2, 1)) > far[:, None]))
            live, kept = _bits(alive), np.zeros(place.shape, bool)
            for i in range(place.shape[1]):
                one = live >> np.uint64(i) & np.uint64(1)
                kept[:, i] = one
                live &= ~(ruled[:, i] * one)
            rank = count[rows, None] + np.cumsum(kept, 1)
            who, which = np.nonzero(kept & (rank <= degree))
            picked[rows[who], rank[who, which] - 1] = place[who, which]
            count[rows] = np.minimum(rank[:, -1], degree)
        for which, own_cand, own_picked, n in zip(part.tolist(), cand, picked, count.tolist(), strict=True):
            out[which] = own_cand[own_picked[:n]].tolist()
    return out


class Adjacency:
    """Neighbours of nodes as rows of one array, -1 where there are fewer. Pruning leaves degree of them; links back may add half as many before a node is pruned."""

    def __init__(self, graph: list, degree: int) -> None:
        self.degree = degree
        self.near = np.full((len(graph), degree + (degree + 1) // 2), -1, np.int64)
        self.size = np.array([len(own) for own in graph], np.int64)
        for i, own in enumerate(graph):
            self.near[i, : len(own)] = own

    def of(self, node: int) -> np.ndarray:
        return self.near[node, : self.size[node]]

    def put(self, node: int, own: list[int] | np.ndarray) -> None:
        self.near[node, : len(own)], self.near[node, len(own) :], self.size[node] = own, -1, len(own)

    def prune(self, nodes: np.ndarray, pools: list[np.ndarray], vectors: np.ndarray, alpha: float) -> None:
        for i, own in zip(nodes.tolist(), prune_many(nodes, pools, vectors, alpha, self.degree), strict=True):
            self.put(i, own)

    def link(self, nodes: np.ndarray, pools: list[np.ndarray], vectors: np.ndarray, alpha: float) -> None:
        """Each of nodes gets what pruning leaves of its pool, and these get it back; what has no room for more is pruned."""
        self.prune(nodes, pools, vectors, alpha)
        own = self.near[nodes]
        who, place = np.nonzero(own >= 0)
        to, back = own[who, place], nodes[who]
        new = ~(self.near[to] == back[:, None]).any(1)
        order = np.argsort(to[new], kind="stable")
        to, back = to[new][order], back[new][order]
        at, begin, more = np.unique(to, return_index=True, return_counts=True)
        room = self.size[at] + more <= self.near.shape[1]
        slot = np.arange(len(to)) - np.repeat(begin, more) + np.repeat(self.size[at], more)
        fits = np.repeat(room, more)
        self.near[to[fits], slot[fits]] = back[fits]
        self.size[at[room]] += more[room]
        full = at[~room]
        self.prune(full, [np.concatenate([self.of(j), back[x : x + n]]) for j, x, n in zip(full.tolist(), begin[~room].tolist(), more[~room].tolist(), strict=True)], vectors, alpha)

    def settle(self, vectors: np.ndarray, alpha: float) -> list[list[int]]:
        """Neighbours of each node, once those that have more than degree are pruned."""
        over = np.flatnonzero(self.size > self.degree)
        self.prune(over, [self.of(i) for i in over.tolist()], vectors, alpha)
        return [self.of(i).tolist() for i in range(len(self.near))]


Measure = Callable[[np.ndarray, np.ndarray], np.ndarray]


def exactly(queries: np.ndarray, vectors: np.ndarray) -> Measure:
    """Squared distances of queries (by number) to nodes."""
    q, v = queries.astype(np.float32), vectors.astype(np.float32, copy=False)

    def measure(row: np.ndarray, node: np.ndarray) -> np.ndarray:
        diff = v[node] - q[row]
        return np.einsum("ij,ij->i", diff, diff)

    return measure


def by_codes(queries: np.ndarray, centroid: np.ndarray, sign: np.ndarray, sq: np.ndarray, l1: np.ndarray) -> Measure:
    """Estimated distances of queries (by number) to nodes."""
    q = queries.astype(np.float64) - centroid.astype(np.float64)
    qsq = (q * q).sum(1)

    def measure(row: np.ndarray, node: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            d = qsq[row] + sq[node] - 2 * sq[node] * np.einsum("ij,ij->i", sign[node], q[row]) / l1[node]
        return np.where(l1[node] == 0, sq[node], d)

    return measure


def exact_table(queries: np.ndarray, vectors: np.ndarray, sq: np.ndarray) -> np.ndarray:
    """exactly() of a batch of queries and all nodes, whose squared norms are sq."""
    table = queries @ vectors.T
    table *= -2
    table += sq
    table += np.einsum("ij,ij->i", queries, queries)[:, None]
    return table


def code_table(queries: np.ndarray, centroid: np.ndarray, sign: np.ndarray, sq: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """by_codes() of a batch of queries and all nodes."""
    q = queries.astype(np.float64) - centroid.astype(np.float64)
    table = q @ sign.T
    table *= -2 * np.divide(sq, l1, out=np.zeros_like(sq), where=l1 != 0)
    table += sq
    table += np.where(l1 == 0, 0, (q * q).sum(1)[:, None])
    return table


def search_many(measure: Measure | np.ndarray, queries: int, near: np.ndarray, start: int, width: int, ahead: int = 8) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each query the width best nodes that best-first search from start meets (best first, -1 where there are fewer), and those it looked into.

    Queries go side by side: in each step every one of them looks into its `ahead` best nodes that it hasn't yet, until the width best
    are all looked into. A node is measured once per query, or looked up, if measure is a table (queries x nodes). A beam as wide as the
    graph meets all that start reaches, so then there are no steps.
    """
    b, n = queries, len(near)
    known = isinstance(measure, np.ndarray)
    if width >= n:
        met = np.flatnonzero(reached_by(near, start))
        d = measure[:, met] if known else measure(np.repeat(np.arange(b), len(met)), np.tile(met, b)).reshape(b, -1)
        best = np.full((b, width), -1, np.int64)
        best[:, : len(met)] = met[np.argsort(d, axis=1, kind="stable")]
        return best, [met] * b
    flat = measure.ravel() if known else None
    seen, last = np.zeros(b * n, bool), np.empty(b * n, np.int32)
    seen[np.arange(b) * n + start] = True
    best = np.full((b, width), -1, np.int64)
    far = np.full((b, width), np.inf, measure.dtype if known else float)
    opened = np.ones((b, width), bool)
    best[:, 0], opened[:, 0] = start, False
    far[:, 0] = measure[:, start] if known else measure(np.arange(b), np.full(b, start))
    looked: list[tuple[np.ndarray, np.ndarray]] = []
    while not opened.all():
        # The list is sorted, so the best that aren't looked into are the first ones.
        who, at = np.nonzero(~opened & (np.cumsum(~opened, 1) <= ahead))
        opened[who, at] = True
        nodes = best[who, at]
        looked.append((who, nodes))
        to = near[nodes]
        row, to = np.repeat(who, near.shape[1]), to.ravel()
        if known:  # what isn't good enough needs no mark, as it never will be
            cell = row * n + to
            keep = np.flatnonzero((flat[cell] < far[row, -1]) & ~seen[cell] & (to >= 0))
        else:
            cell = row * n + to
            keep = np.flatnonzero((to >= 0) & ~seen[cell])
        row, to, cell = row[keep], to[keep], cell[keep]
        last[cell] = np.arange(len(cell))
        once = last[cell] == np.arange(len(cell))
        row, to, cell = row[once], to[once], cell[once]
        seen[cell] = True
        if known:
            d = flat[cell]
        else:
            d = measure(row, to)
            good = d < far[row, -1]
            row, to, d = row[good], to[good], d[good]
        if not len(row):
            continue
        count = np.bincount(row, minlength=b)  # row ascends
        rows = np.flatnonzero(count)
        count = count[rows]
        place, slot = np.repeat(np.arange(len(rows)), count), np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        more, more_far = np.full((len(rows), count.max()), -1, np.int64), np.full((len(rows), count.max()), np.inf, far.dtype)
        more[place, slot], more_far[place, slot] = to, d
        both_far = np.concatenate([far[rows], more_far], 1)
        order = np.argsort(both_far, axis=1, kind="stable")[:, :width]
        best[rows] = np.take_along_axis(np.concatenate([best[rows], more], 1), order, 1)
        far[rows] = np.take_along_axis(both_far, order, 1)
        opened[rows] = np.take_along_axis(np.concatenate([opened[rows], more < 0], 1), order, 1)
    who, nodes = (np.concatenate(x) for x in zip(*looked, strict=True))
    return best, np.split(nodes[np.argsort(who, kind="stable")], np.cumsum(np.bincount(who, minlength=b))[:-1])


def nearest_centres(vectors: np.ndarray, centres: np.ndarray, m: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The m nearest centres of each row, nearest first, and their squared distances."""
    c, m = centres.astype(np.float64), min(m, len(centres))
    who, far = np.empty((len(vectors), m), np.int64), np.empty((len(vectors), m))
    norms = (c * c).sum(1)
    for at in range(0, len(vectors), block):
        v = vectors[at : at + block].astype(np.float64)
        d = np.maximum(norms[None] - 2 * v @ c.T + (v * v).sum(1)[:, None], 0)
        who[at : at + block] = np.argsort(d, axis=1, kind="stable")[:, :m]
        far[at : at + block] = np.take_along_axis(d, who[at : at + block], 1)
    return who, far


def coarse_centres(vectors: np.ndarray, cells: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centres of cells groups of the vectors (as many as there are different vectors, if fewer) by Lloyd's rounds; a group that gets nothing takes the vector that is farthest from its centre."""
    rng, v = np.random.default_rng(seed), np.unique(vectors, axis=0).astype(np.float64)
    centres = v[rng.choice(len(v), min(cells, len(v)), replace=False)]
    for _ in range(rounds):
        own, far = (x[:, 0] for x in nearest_centres(v, centres, 1))
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, v)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        centres[count == 0] = v[np.argsort(-far, kind="stable")[: (count == 0).sum()]]
    return centres.astype(np.float32)


def random_neighbours(n: int, degree: int, seed: int) -> list[np.ndarray]:
    """min(degree, n - 1) distinct others of each node."""
    rng, m = np.random.default_rng(seed), min(degree, n - 1)
    return [(i + 1 + rng.choice(n - 1, m, replace=False)) % n for i in range(n)]


def medoid(vectors: np.ndarray) -> int:
    return int(l2_to(vectors.astype(np.float64).mean(0), vectors).argmin())


def reached(graph: list[list[int]], start: int) -> np.ndarray:
    seen = np.zeros(len(graph), bool)
    seen[start], todo = True, [start]
    while todo:
        todo = [j for i in todo for j in graph[i] if not seen[j] and not seen.__setitem__(j, True)]
    return seen


def reached_by(near: np.ndarray, start: int) -> np.ndarray:
    """reached(), of neighbours as rows of one array, -1 where there are fewer."""
    seen, todo = np.zeros(len(near), bool), np.array([start])
    while len(todo):
        seen[todo] = True
        met = near[todo].ravel()
        met = met[met >= 0]
        todo = np.unique(met[~seen[met]])
    return seen


def strong_components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """For each of n nodes one that stands for all that it reaches and that reach it. Nodes are split by what a pivot reaches and what reaches it, until each part is one component."""
    out, parts = np.arange(n), [np.arange(n)] if n else []
    while parts:
        own = parts.pop()
        inside = np.zeros(n, bool)
        inside[own] = True
        keep = inside[src] & inside[dst]
        src_, dst_ = src[keep], dst[keep]
        has_in, has_out = np.zeros(n, bool), np.zeros(n, bool)
        has_in[dst_], has_out[src_] = True, True
        own = own[has_in[own] & has_out[own]]  # others are components of their own
        if not len(own):
            continue
        ahead, behind = _flood(n, own[0], src_, dst_), _flood(n, own[0], dst_, src_)
        out[ahead & behind] = own[0]
        parts += [p for p in (own[ahead[own] & ~behind[own]], own[behind[own] & ~ahead[own]], own[~ahead[own] & ~behind[own]]) if len(p) > 1]
    return out


def _flood(n: int, start: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    seen, count = np.zeros(n, bool), 0
    seen[start] = True
    while count != (count := int(seen.sum())):
        seen[dst[seen[src]]] = True
    return seen


def build_graph(vectors: np.ndarray, *, degree: int, search_list: int, passes: int, alpha: float, seed: int) -> tuple[list[list[int]], int]:
    """Neighbours of each node (degree at most) and the medoid, from which every node is reached.

    From a random graph, passes times: nodes are taken in a shuffled order; what a search for one from the medoid looks into, its search_list best and
    its neighbours are its pool, which is pruned, and its new neighbours are linked back (`Adjacency.link`). A batch of nodes searches the graph as the
    batch before left it. Nodes that can't be reached in the end are hung below the nearest node that can.
    """
    n = len(vectors)
    start = medoid(vectors) if n else -1
    if n < 2:
        return [[] for _ in range(n)], start
    graph, rng = Adjacency(random_neighbours(n, degree, seed), degree), np.random.default_rng([seed, n])
    for _ in range(passes):
        refine(graph, rng.permutation(n), vectors, start, search_list, alpha)
    return attach(graph.settle(vectors, alpha), vectors, start, degree), start


def refine(graph: Adjacency, order: np.ndarray, vectors: np.ndarray, start: int, search_list: int, alpha: float, most: int = 128) -> None:
    """Links the nodes in order anew, in batches of most nodes, or a sixteenth of all if that is fewer, as a batch's nodes don't see each other's links."""
    batch = max(1, min(most, len(vectors) // 16))
    centred = (vectors - vectors.astype(np.float64).mean(0)).astype(np.float32)
    sq = np.einsum("ij,ij->i", centred, centred)
    for at in range(0, len(order), batch):
        nodes = order[at : at + batch]
        best, looked = search_many(exact_table(centred[nodes], centred, sq), len(nodes), graph.near, start, search_list)
        graph.link(nodes, [np.concatenate([b[b >= 0], x, graph.of(i)]) for i, b, x in zip(nodes.tolist(), best, looked, strict=True)], vectors, alpha)


def extend_graph(graph: list[list[int]], vectors: np.ndarray, start: int, *, degree: int, search_list: int, alpha: float) -> list[list[int]]:
    """graph, of the first of vectors, with nodes for the others, which are searched for and linked as in a build."""
    n = len(vectors)
    grown = Adjacency(graph + [[]] * (n - len(graph)), degree)
    refine(grown, np.arange(len(graph), n), vectors, start, search_list, alpha)
    return attach(grown.settle(vectors, alpha), vectors, start, degree)


def hops(graph: list, start: int, depth: int) -> np.ndarray:
    """How many steps each node is from start; -1 beyond depth."""
    out = np.full(len(graph), -1, np.int64)
    out[start], todo = 0, [start]
    for step in range(1, depth + 1):
        todo = [int(j) for j in dict.fromkeys(int(j) for i in todo for j in graph[i]) if out[j] < 0]
        out[todo] = step
    return out


def attach(graph: list[list[int]], vectors: np.ndarray, start: int, degree: int) -> list[list[int]]:
    """Hangs nodes that can't be reached below near ones that can; edges that were made for this are never given up again."""
    kept: set[tuple[int, int]] = set()
    seen = reached(graph, start)
    while not seen.all():
        lost = int(np.flatnonzero(~seen)[0])
        inside = np.flatnonzero(seen)
        near = inside[np.argsort(l2_to(vectors[lost], vectors[inside]), kind="stable")]
        room = next((int(at) for at in near if len(graph[at]) < degree), None)
        if room is not None:
            graph[room] = [*graph[room], lost]
            kept.add((room, lost))
            seen |= reached(graph, lost)
            continue
        for at in map(int, near):
            free = [j for j in graph[at] if (at, j) not in kept]
            if not free:
                continue
            far = max(free, key=lambda j: float(l2_to(vectors[at], vectors[j : j + 1])[0]))
            was, graph[at] = graph[at], [j for j in graph[at] if j != far] + [lost]
            now = reached(graph, start)
            if now.sum() > seen.sum():
                kept.add((at, lost))
                seen = now
                break
            graph[at] = was
        else:
            raise RuntimeError("the degree is too small to reach every node")
    return graph
