"""A robust-pruned directed graph over unit vectors, built and searched in numpy batches.

Points are inserted in batches of doubling size. For each batch a greedy beam search over the graph so
far proposes neighbours; relaxed distance pruning keeps a diverse few of them: candidate c is dropped
when a kept neighbour k has ``alpha * d(k, c) <= d(p, c)`` (squared distances, so alpha is the square
of the usual one). Reverse edges are added, and nodes over ``degree`` pruned by the same rule.
"""

from __future__ import annotations

import numpy as np


_FIX = 1 << 29
_NONE = np.int64(0)
_ID = np.int64(0xFFFFFFFF)


def _key(sims: np.ndarray, node: np.ndarray) -> np.ndarray:
    return (((sims + 1.5) * _FIX).astype(np.int64) << 32) | (node.astype(np.int64) << 1) | 1


class Graph:
    def __init__(self, x: np.ndarray, degree: int = 20, beam: int = 24, alpha: float = 1.2, seed: int = 7, batch: int = 256, pivots: int = 128) -> None:
        self.x = np.ascontiguousarray(x, np.float32)
        self.n = len(x)
        self.degree, self.beam, self.alpha, self.batch, self.pivots = degree, beam, alpha, batch, pivots
        self.slack = degree + degree // 2
        self.nbr = np.full((self.n, self.slack), -1, np.int32)
        self.deg = np.zeros(self.n, np.int32)
        self._build(np.random.default_rng(seed))

    def _build(self, rng: np.random.Generator) -> None:
        order = self.order = rng.permutation(self.n).astype(np.int32)
        head = min(self.n, 2 * self.beam)
        if head > 1:  # the first few see each other in full
            ids = order[:head]
            sims = self.x[ids] @ self.x[ids].T
            np.fill_diagonal(sims, -np.inf)
            rank = np.argsort(-sims, axis=1)[:, : head - 1]
            self._link(ids, ids[rank], np.take_along_axis(sims, rank, 1))
        self.built = head
        while self.built < self.n:
            ids = order[self.built : self.built + min(max(self.built, 32), self.batch)]
            got, sims = self.search(self.x[ids], self._starts(self.x[ids]))
            self._link(ids, got, sims)
            self.built += len(ids)

    def _prune(self, ids: np.ndarray, cand: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Up to ``degree`` diverse neighbours of each of ``ids``; cand is sorted, -1 where empty."""
        b, c = cand.shape
        alive = (cand >= 0) & (cand != ids[:, None]) & np.isfinite(sims)
        v = self.x[np.maximum(cand, 0)]
        gap = (1.0 - v @ v.transpose(0, 2, 1)) * self.alpha
        own = 1.0 - sims
        out = np.full((b, self.degree), -1, np.int32)
        rows = np.arange(b)
        for k in range(self.degree):
            pick = alive.argmax(1)
            ok = alive[rows, pick]
            if not ok.any():
                break
            out[ok, k] = cand[rows, pick][ok]
            alive[rows, pick] = False
            drop = gap[rows, pick] <= own
            drop[~ok] = False
            alive &= ~drop
        return out

    def _link(self, ids: np.ndarray, cand: np.ndarray, sims: np.ndarray) -> None:
        kept = self._prune(ids, cand, sims)
        d = kept.shape[1]
        self.nbr[ids, :d] = kept
        self.deg[ids] = (kept >= 0).sum(1)
        src = np.repeat(ids, d)
        dst = kept.ravel()
        real = dst >= 0
        self._back(dst[real], src[real])

    def _back(self, node: np.ndarray, new: np.ndarray) -> None:
        """Edges node -> new; nodes that overflow are pruned over all they have."""
        if not len(node):
            return
        order = np.argsort(node, kind="stable")
        node, new = node[order], new[order]
        already = (self.nbr[node] == new[:, None]).any(1)
        node, new = node[~already], new[~already]
        if not len(node):
            return
        uniq, first, count = np.unique(node, return_index=True, return_counts=True)
        rank = np.arange(len(node)) - np.repeat(first, count)
        slot = self.deg[node] + rank
        fits = np.repeat(self.deg[uniq] + count <= self.slack, count)
        self.nbr[node[fits], slot[fits]] = new[fits]
        small = self.deg[uniq] + count <= self.slack
        self.deg[uniq[small]] += count[small]
        over = uniq[~small]
        if not len(over):
            return
        width = int((self.deg[over] + count[~small]).max())
        for lo in range(0, len(over), 512):
            part = over[lo : lo + 512]
            cand = np.full((len(part), width), -1, np.int32)
            cand[:, : self.slack] = self.nbr[part]
            at = np.searchsorted(part, node[~fits])
            mine = (at < len(part)) & (part[np.minimum(at, len(part) - 1)] == node[~fits])
            cand[at[mine], slot[~fits][mine]] = new[~fits][mine]
            sims = np.einsum("bcd,bd->bc", self.x[np.maximum(cand, 0)], self.x[part])
            sims[cand < 0] = -np.inf
            keep = np.argsort(-sims, axis=1)[:, : 3 * self.degree]
            kept = self._prune(part, np.take_along_axis(cand, keep, 1), np.take_along_axis(sims, keep, 1))
            self.nbr[part] = -1
            self.nbr[part, : self.degree] = kept
            self.deg[part] = (kept >= 0).sum(1)

    def _starts(self, q: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """The two best pivots of each query (pivots: the nodes inserted first), and its own node."""
        piv = self.order[: min(self.built, self.pivots)]
        s = q @ self.x[piv].T
        w = min(2, len(piv))
        top = np.argpartition(-s, w - 1, axis=1)[:, :w] if w < len(piv) else np.broadcast_to(np.arange(w), (len(q), w))
        out = piv[top]
        return out if own is None else np.concatenate([out, own[:, None]], 1)

    def search(self, q: np.ndarray, start: np.ndarray, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Greedy beam search of each query from its start nodes (-1: none): ids and cosines, best first.

        A beam entry is one integer: the cosine in fixed point, the node, and whether it is still to be
        expanded, so that merging a step's finds is one sort of a row. -1 pads the ids.
        """
        beam = beam or self.beam
        b = len(q)
        seen = np.zeros(b * self.n, bool)
        keys = np.full((b, beam), _NONE, np.int64)
        r, c = np.nonzero(start >= 0)
        node = start[r, c]
        seen[r * self.n + node] = True
        first = np.full(start.shape, _NONE, np.int64)
        first[r, c] = _key(np.einsum("ij,ij->i", self.x[node], q[r]), node)
        first.sort(axis=1)
        first[:, 1:][first[:, 1:] == first[:, :-1]] = _NONE
        first.sort(axis=1)
        w = min(beam, first.shape[1])
        keys[:, beam - w :] = first[:, first.shape[1] - w :]
        live = np.arange(b)
        mine = keys
        while len(live):
            # the best entry still to be expanded, of each live query
            pick = beam - 1 - (mine[:, ::-1] & 1).argmax(1)
            spot = np.arange(len(live)) * beam + pick
            at = mine.ravel().take(spot)
            ok = (at & 1) == 1
            if not ok.all():
                keys[live[~ok]] = mine[~ok]
                live, at, mine, pick = live[ok], at[ok], mine[ok], pick[ok]
                if not len(live):
                    break
                spot = np.arange(len(live)) * beam + pick
            mine.ravel()[spot] -= 1
            near = self.nbr.take((at & _ID) >> 1, axis=0)
            place = near + (live * self.n)[:, None]
            hit = np.flatnonzero((near >= 0) & ~seen.take(place, mode="clip"))
            where = place.ravel().take(hit)
            seen[where] = True
            found = near.ravel().take(hit)
            row = hit // near.shape[1]
            k = _key(np.einsum("ij,ij->i", self.x.take(found, axis=0), q.take(live.take(row), axis=0)), found)
            good = k > mine[:, 0].take(row)
            fresh = np.zeros(near.shape, np.int64)
            fresh.ravel()[hit[good]] = k[good]
            both = np.concatenate([mine, fresh], 1)
            both.sort(axis=1)
            mine = np.ascontiguousarray(both[:, -beam:])
        keys = keys[:, ::-1]
        real = keys > _NONE
        ids = np.where(real, (keys & _ID) >> 1, -1).astype(np.int32)
        sims = np.where(real, (keys >> 32) / _FIX - 1.5, -np.inf).astype(np.float32)
        return ids, sims

    def neighbours(self, q: np.ndarray, own: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """k best nodes of each query; ``own`` is its node here (never returned), or -1 for a guest."""
        ids = np.full((len(q), k), -1, np.int32)
        sims = np.full((len(q), k), -np.inf, np.float32)
        if not self.n:
            return ids, sims
        for lo in range(0, len(q), self.batch):
            o = own[lo : lo + self.batch].astype(np.int32)
            part = q[lo : lo + self.batch]
            i, s = self.search(part, self._starts(part, o), beam)
            s[(i < 0) | (i == o[:, None])] = -np.inf
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            w = top.shape[1]
            ids[lo : lo + self.batch, :w] = np.take_along_axis(i, top, 1)
            sims[lo : lo + self.batch, :w] = np.take_along_axis(s, top, 1)
        return np.where(np.isfinite(sims), ids, -1), sims
