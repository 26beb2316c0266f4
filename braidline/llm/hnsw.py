"""A hierarchical navigable small-world graph over unit vectors, built and searched for many vectors at a time."""

from __future__ import annotations

import numpy as np


class Graph:
    """Nearest neighbours by cosine. ``links`` is the number of neighbours of a node on the upper levels, twice as many
    on the lowest; ``beam`` the beam's width while building."""

    def __init__(self, vectors: np.ndarray, links: int = 12, beam: int = 48, seed: int = 7):
        self.x = np.ascontiguousarray(vectors, np.float32)
        n = len(self.x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(np.maximum(rng.random(n), 1e-12)) / np.log(links)).astype(int), 6)
        self.order = np.lexsort((rng.random(n), -level))  # high levels first, so that a layer's nodes lie in front
        level = level[self.order]
        self.x = self.x[self.order]
        self.width = [2 * links if k == 0 else links for k in range((level.max() if n else 0) + 1)]
        self.near = [np.full((n if k == 0 else int((level >= k).sum()), w), -1, np.int32) for k, w in enumerate(self.width)]
        done = 0
        while done < n:
            step = min(n - done, max(32, min(done, 512)))
            self._insert(np.arange(done, done + step), level, done, beam)
            done += step

    def _insert(self, new: np.ndarray, level: np.ndarray, done: int, beam: int) -> None:
        q = self.x[new]
        inside = q @ q.T
        np.fill_diagonal(inside, -np.inf)
        entry = np.zeros((len(new), 1), np.int64)
        for k in range(len(self.near) - 1, -1, -1):
            here = np.flatnonzero(level[new] >= k)
            old = min(done, len(self.near[k]))
            ids, sims = np.full((len(new), 1), -1, np.int64), np.full((len(new), 1), -np.inf, np.float32)
            if old:
                ids, sims = self.search_layer(q, entry, k, beam if len(here) else 1)
                entry = np.maximum(ids[:, : max(1, min(4, ids.shape[1]))], 0)
            if not len(here):
                continue
            own = inside[np.ix_(here, here)]
            most = min(len(here), beam // 2)
            top = np.argpartition(-own, most - 1, axis=1)[:, :most] if most else np.zeros((len(here), 0), int)
            both = np.concatenate([ids[here], np.where(np.isfinite(np.take_along_axis(own, top, 1)), new[here][top], -1)], axis=1)
            score = np.concatenate([sims[here], np.take_along_axis(own, top, 1)], axis=1)
            score[both < 0] = -np.inf
            w = self.width[k]
            self.near[k][new[here]] = self._diverse(both, score, w)
            source = np.repeat(new[here], w)
            target = self.near[k][new[here]].reshape(-1)
            some = target >= 0
            self._link_back(k, target[some], source[some])

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
        """Of each row the candidates that are closer to the row's vector than to any chosen before, best first; free
        places go to the best of the others."""
        at = np.argsort(-sims, axis=1)[:, : 3 * keep]
        ids, sims = np.take_along_axis(ids, at, 1), np.take_along_axis(sims, at, 1)
        v = self.x[np.maximum(ids, 0)]
        among = np.einsum("bid,bjd->bij", v, v)
        chosen = np.zeros(ids.shape, bool)
        for k in range(ids.shape[1]):
            good = np.isfinite(sims[:, k]) & (ids[:, k] >= 0) & (chosen.sum(1) < keep)
            worse = (chosen & (among[:, k, :] > sims[:, k : k + 1])).any(1)
            chosen[:, k] = good & ~worse
        rank = np.where(chosen, 0, 1) + np.where(ids >= 0, 0, 2)
        first = np.argsort(rank, axis=1, kind="stable")[:, :keep]
        out = np.take_along_axis(np.where(np.isfinite(sims), ids, -1), first, 1)
        if out.shape[1] < keep:
            out = np.concatenate([out, np.full((len(out), keep - out.shape[1]), -1, out.dtype)], axis=1)
        return out.astype(np.int32)

    def _link_back(self, k: int, node: np.ndarray, other: np.ndarray) -> None:
        order = np.argsort(node, kind="stable")
        node, other = node[order], other[order]
        own, start, count = np.unique(node, return_index=True, return_counts=True)
        for lo in range(0, len(own), 512):
            part, c, s = own[lo : lo + 512], np.minimum(count[lo : lo + 512], 96), start[lo : lo + 512]
            fresh = np.full((len(part), int(c.max())), -1, np.int64)
            for j in range(fresh.shape[1]):
                has = c > j
                fresh[has, j] = other[s[has] + j]
            both = np.concatenate([self.near[k][part].astype(np.int64), fresh], axis=1)
            sims = np.einsum("bd,bcd->bc", self.x[part], self.x[np.maximum(both, 0)])
            sims[both < 0] = -np.inf
            self.near[k][part] = self._diverse(both, sims, self.width[k])

    def search_layer(self, q: np.ndarray, entry: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the best ``beam`` nodes that the layer's links lead to, best first."""
        n, rows = len(self.near[k]), len(q)
        beam = max(1, min(beam, n))
        seen = np.zeros((rows, n), bool)
        ids = np.full((rows, beam), -1, np.int64)
        sims = np.full((rows, beam), -np.inf, np.float32)
        open_ = np.zeros((rows, beam), bool)

        def take(live: np.ndarray, cand: np.ndarray) -> None:
            ok = (cand >= 0) & (cand < n)
            safe = np.where(ok, cand, 0)
            ok &= ~seen[live[:, None], safe]
            s = np.sort(np.where(ok, cand, -1 - np.arange(cand.shape[1])), axis=1)  # the same node twice counts once
            ok = s >= 0
            ok[:, 1:] &= s[:, 1:] != s[:, :-1]
            safe = np.where(ok, s, 0)
            r, c = np.nonzero(ok)
            seen[live[r], safe[r, c]] = True
            new = np.einsum("bd,bcd->bc", q[live], self.x[safe])
            new[~ok] = -np.inf
            both_i, both_s = np.concatenate([ids[live], safe], 1), np.concatenate([sims[live], new], 1)
            both_o = np.concatenate([open_[live], ok], 1)
            top = np.argpartition(-both_s, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], open_[live] = np.take_along_axis(both_i, top, 1), np.take_along_axis(both_s, top, 1), np.take_along_axis(both_o, top, 1)

        take(np.arange(rows), entry)
        live = np.arange(rows)
        while len(live):
            score = np.where(open_[live], sims[live], -np.inf)
            wide = min(2, beam)
            pick = np.argpartition(-score, wide - 1, axis=1)[:, :wide] if beam > wide else np.argsort(-score, axis=1)[:, :wide]
            good = np.isfinite(np.take_along_axis(score, pick, 1))
            some = good.any(1)
            live, pick, good = live[some], pick[some], good[some]
            if not len(live):
                break
            open_[live[:, None], pick] = False
            nodes = ids[live[:, None], pick]
            cand = self.near[k][nodes]
            cand = np.where(good[:, :, None], cand, -1).reshape(len(live), -1).astype(np.int64)
            take(live, cand)
        best = np.argsort(-sims, axis=1)
        ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
        ids[~np.isfinite(sims)] = -1
        return ids, sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the vectors given and their cosines, best first; -1 beyond what was found."""
        q = np.ascontiguousarray(q, np.float32)
        entry = np.zeros((len(q), 1), np.int64)
        for k in range(len(self.near) - 1, 0, -1):
            ids, _ = self.search_layer(q, entry, k, 4)
            entry = np.maximum(ids, 0)
        ids, sims = self.search_layer(q, entry, 0, beam)
        return np.where(ids >= 0, self.order[np.maximum(ids, 0)], -1), sims
