"""Hierarchical navigable small-world graphs in NumPy, with whole batches searched in step.

Similarity is the inner product ("ip", for unit vectors) or minus half the squared distance ("l2")."""

from __future__ import annotations

import io

import numpy as np

#: Links of a node, at the lowest level twice as many; beam while building; rows inserted or searched together.
LINKS, BUILD_BEAM, TOGETHER = 16, 48, 256
#: The similarity of no row.
NONE = np.float32(-3e38)
#: Beam entries that a step expands for each query.
EXPAND = 4


def pack(**arrays) -> bytes:
    """Arrays as one binary value."""
    np.savez(out := io.BytesIO(), **arrays)
    return out.getvalue()


def unpack(blob: bytes) -> dict:
    with np.load(io.BytesIO(blob), allow_pickle=False) as held:
        return {k: held[k] for k in held.files}


def levels(ids: np.ndarray, links: int = LINKS) -> np.ndarray:
    """Geometric levels from a hash of the ids, so that a rebuilt graph is the same."""
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53
    return np.minimum((-np.log(u) / np.log(links)).astype(int), 6)


class Graph:
    """x: vectors (float32); near[level]: links of each row, -1 where there is none."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, *, links: int = LINKS, beam: int = BUILD_BEAM, metric: str = "ip"):
        self._hold(x, metric)
        self.links, self.beam = links, beam
        lv = levels(ids, links)
        self.order = np.lexsort((np.arange(len(x)), -lv))  # upper levels first, so that each is a prefix
        self.sizes = [int((lv >= k).sum()) for k in range(int(lv.max(initial=0)) + 1)]
        self.near = [np.full((len(x), 2 * links if k == 0 else links), -1, np.int32) for k in range(len(self.sizes))]
        for k in reversed(range(len(self.sizes))):
            self._build(k)

    @classmethod
    def of(cls, x: np.ndarray, order: np.ndarray, sizes: list[int], near: list[np.ndarray], metric: str = "ip") -> Graph:
        """A graph that was built before."""
        self = object.__new__(cls)
        self._hold(x, metric)
        self.order, self.sizes, self.near = order, sizes, near
        return self

    def _hold(self, x: np.ndarray, metric: str) -> None:
        self.x = np.ascontiguousarray(x, np.float32)
        self.l2 = metric == "l2"
        self.half = self._halves(self.x)

    def _halves(self, x: np.ndarray) -> np.ndarray:
        return (x * x).sum(axis=1) / 2 if self.l2 else np.zeros(len(x), np.float32)

    def _like(self, q: np.ndarray, half: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Similarity of each query to its rows; NONE for -1."""
        held = np.maximum(rows, 0)
        sims = np.einsum("bd,bcd->bc", q, self.x[held])
        if self.l2:
            sims -= half[:, None] + self.half[held]
        return np.where(rows >= 0, sims, NONE).astype(np.float32)

    def _build(self, k: int) -> None:
        members, at = self.order[: self.sizes[k]], 0
        while at < len(members):
            step = min(TOGETHER, max(8, at), len(members) - at)
            batch = members[at : at + step]
            cand, sims = np.full((step, 0), -1, np.int64), np.zeros((step, 0), np.float32)
            if at:
                cand, sims = self.search(self.x[batch], self.beam, k, first=members[0])
            own = self.x[batch] @ self.x[batch].T - (self.half[batch][:, None] + self.half[batch][None, :])
            own[np.tril_indices(step)] = NONE  # rows after a row; the links back give the others
            cand = np.concatenate((cand, np.broadcast_to(batch, (step, step))), axis=1)
            sims = np.concatenate((sims, own), axis=1)
            cand = np.where(sims > NONE, cand, -1)
            chosen = self._diverse(cand, sims, self.links)
            self.near[k][batch, : chosen.shape[1]] = chosen
            self._link_back(k, batch, chosen)
            at += step

    def _diverse(self, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates the nearest that lie nearer to the row than to one chosen before; then the nearest rest."""
        width = min(cand.shape[1], 64)
        top = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        cand, sims = np.take_along_axis(cand, top, 1), np.take_along_axis(sims, top, 1)
        v = self.x[np.maximum(cand, 0)]
        between = v @ v.transpose(0, 2, 1)
        if self.l2:
            half = self.half[np.maximum(cand, 0)]
            between -= half[:, :, None] + half[:, None, :]
        good = cand >= 0
        chosen = np.zeros_like(good)
        for i in range(width):
            blocked = (chosen[:, :i] & (between[:, i, :i] > sims[:, i : i + 1])).any(axis=1)
            chosen[:, i] = good[:, i] & ~blocked & (chosen.sum(axis=1) < most)
        rank = np.where(chosen, 0, np.where(good, 1, 2))
        pick = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(np.where(good, cand, -1), pick, 1).astype(np.int32)

    def _link_back(self, k: int, rows: np.ndarray, chosen: np.ndarray) -> None:
        near = self.near[k]
        src, to = np.repeat(rows, chosen.shape[1]), chosen.ravel()
        src, to = src[to >= 0], to[to >= 0]
        if not len(to):
            return
        order = np.argsort(to, kind="stable")
        src, to = src[order], to[order]
        nodes, begin, count = np.unique(to, return_index=True, return_counts=True)
        wide = np.full((len(nodes), int(count.max())), -1, np.int64)
        col = np.arange(len(to)) - np.repeat(begin, count)
        wide[np.repeat(np.arange(len(nodes)), count), col] = src
        allc = np.concatenate((near[nodes].astype(np.int64), wide), axis=1)
        have = (allc >= 0).sum(axis=1)
        cap = near.shape[1]
        easy = have <= cap
        packed = np.take_along_axis(allc, np.argsort(allc < 0, axis=1, kind="stable"), 1)
        pad = max(0, cap - packed.shape[1])
        near[nodes[easy]] = np.pad(packed[easy], ((0, 0), (0, pad)), constant_values=-1)[:, :cap]
        for part in np.array_split(np.nonzero(~easy)[0], max(1, (~easy).sum() // TOGETHER)):
            if len(part):
                c = packed[part]
                near[nodes[part]] = self._diverse(c, self._like(self.x[nodes[part]], self.half[nodes[part]], c), cap)

    def search(self, q: np.ndarray, beam: int, k: int = 0, *, first: int | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Beam search at level k of every query at once: (rows, similarities), best first, -1 where the beam isn't full.

        own: rows that start a query's search beside the entry point, such as the query itself."""
        entry = np.full(len(q), self.order[0] if first is None else first)
        if first is None:
            for level in range(len(self.sizes) - 1, k, -1):
                entry = self._from(q, entry, 1, level)[0][:, 0]
        starts = entry[:, None] if own is None else np.stack((entry, own), axis=1)
        return self._from(q, starts, beam, k)

    def _from(self, q: np.ndarray, starts: np.ndarray, beam: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        b = len(q)
        starts = starts.reshape(b, -1)
        seen = np.zeros((b, len(self.x) + 1), bool)
        seen[:, -1] = True
        if starts.shape[1] == 2:
            starts = np.where(starts[:, :1] == starts[:, 1:], np.stack((starts[:, 0], np.full(b, -1)), axis=1), starts)
        ids = starts.astype(np.int64)
        half = self._halves(q)
        sims = self._like(q, half, ids)
        np.put_along_axis(seen, np.where(ids >= 0, ids, len(self.x)), True, 1)
        done = ids < 0
        live = np.arange(b)
        out_ids, out_sims = np.full((b, beam), -1, np.int64), np.full((b, beam), NONE, np.float32)
        near = self.near[k]
        while len(live):
            todo = np.where(done, -np.inf, sims)
            pick = np.argsort(-todo, axis=1)[:, :EXPAND]
            fresh = np.take_along_axis(todo, pick, 1) > -np.inf
            going = fresh[:, 0]
            if not going.all():
                over = ~going
                w = min(beam, ids.shape[1])
                out_ids[live[over], :w], out_sims[live[over], :w] = ids[over][:, :w], sims[over][:, :w]
                live, ids, sims, done, pick, fresh, seen, q, half = live[going], ids[going], sims[going], done[going], pick[going], fresh[going], seen[going], q[going], half[going]
                if not len(live):
                    break
            np.put_along_axis(done, pick, True, 1)
            nodes = np.take_along_axis(ids, pick, 1)
            nxt = np.where(fresh[:, :, None], near[np.maximum(nodes, 0)], -1).reshape(len(live), -1).astype(np.int64)
            nxt = np.where(nxt >= 0, nxt, len(self.x))
            nxt = np.where(np.take_along_axis(seen, nxt, 1), len(self.x), nxt)
            nxt.sort(axis=1)
            nxt[:, 1:][nxt[:, 1:] == nxt[:, :-1]] = len(self.x)
            nxt.sort(axis=1)
            nxt = nxt[:, : max(1, int((nxt < len(self.x)).sum(axis=1).max()))]
            np.put_along_axis(seen, nxt, True, 1)
            fresh_ids = np.where(nxt < len(self.x), nxt, -1)
            ids = np.concatenate((ids, fresh_ids), axis=1)
            sims = np.concatenate((sims, self._like(q, half, fresh_ids)), axis=1)
            done = np.concatenate((done, nxt == len(self.x)), axis=1)
            top = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            ids, sims, done = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1), np.take_along_axis(done, top, 1)
        return out_ids, out_sims
