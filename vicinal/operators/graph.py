"""A proximity graph over the vectors of one shard, held in NumPy arrays.

One layer, node 0 is the entry. A new node links to the neighbours that a diversity rule
keeps out of its beam; a full list is pruned again from its owner's point of view. Beams of
many queries step together, and new nodes are taken in batches that look at one another too.
"""

from __future__ import annotations

import numpy as np

from vicinal.operators.exact import exact_rows

#: Nodes that a search looks at from together, at least: NumPy takes about as long for one as for some.
LEAST_TOGETHER = 8
#: Marks of met nodes that the queries which step together have at most, unless one query has more.
GROUP_MARKS = 1 << 20
#: New nodes that look for their neighbours together, at most: no more than an eighth of those that are there.
MOST_NEW = 512
#: Vectors that are subtracted at a time: few enough for a processor's cache.
CACHED_ROWS = 512
_NONE = np.iinfo(np.int64).max


class ShardGraph:
    """Build and beam search. ``m`` links per new node, ``2 * m`` at most; ties go by node number."""

    def __init__(self, vectors: np.ndarray, metric: str, m: int, efconstruction: int, packed: tuple[np.ndarray, np.ndarray] | None = None):
        """``packed``: the number of links of every node and all links, as ``packed()`` gives them; the graph is built without."""
        self.vectors, self.metric, self.m, self.efconstruction = vectors, metric, m, efconstruction
        self._prepare()
        if packed is not None:
            self._degrees, self._links = packed[0].astype(np.int64), packed[1]
            self._starts = np.cumsum(self._degrees) - self._degrees
            self.count = len(vectors)
            return
        self._width = min(2 * m, 64)  # of the table that takes the links while it is built; it grows
        self._degrees, self._links = np.zeros(len(vectors), dtype=np.int64), np.zeros(len(vectors) * self._width, dtype=np.int32)
        self._starts = np.arange(len(vectors)) * self._width
        self.count = min(1, len(vectors))
        while self.count < len(vectors):
            self._add(min(len(vectors) - self.count, MOST_NEW, max(1, self.count // 8)))
        self._degrees, self._links = self.packed()
        self._starts = np.cumsum(self._degrees) - self._degrees

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of links of every node, and the links of all nodes in turn."""
        return self._degrees, self._links[self._places(np.arange(len(self._degrees)))]

    @property
    def links(self) -> list[np.ndarray]:
        return np.split(self.packed()[1], np.cumsum(self._degrees)[:-1]) if len(self._degrees) else []

    # -- distances ----------------------------------------------------------------------
    def _prepare(self) -> None:
        """What the steps of a beam compute with. Its finds are ranked by double distances afterwards."""
        exact = self.vectors.astype(np.float64)
        if self.metric == "cosine":  # one minus a product needs all digits
            self._own = self._unit(exact)
        else:
            size = np.abs(exact).max(initial=0.0)
            self._own = exact if size > 1e15 or 0 < size < 1e-15 else exact.astype(np.float32)

    @staticmethod
    def _unit(vectors: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return vectors / np.sqrt((vectors**2).sum(1))[:, None]

    def _asked(self, queries: np.ndarray) -> np.ndarray:
        if self.metric == "cosine":
            return self._unit(queries.astype(np.float64))
        if np.abs(queries).max(initial=0.0) > 1e15:
            self._own = self._own.astype(np.float64)
        return queries.astype(self._own.dtype)

    def _keys(self, asked: np.ndarray, whose: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Distances of the pairs of query and node in single precision; NaN is infinite."""
        found, ones = np.empty(len(nodes), dtype=self._own.dtype), np.ones(self._own.shape[1], dtype=self._own.dtype)
        with np.errstate(over="ignore", invalid="ignore"):
            for at in range(0, len(nodes), CACHED_ROWS):
                part = slice(at, at + CACHED_ROWS)
                have, query = self._own.take(nodes[part], axis=0), asked.take(whose[part], axis=0)
                if self.metric == "cosine":
                    found[part] = np.multiply(have, query, out=have) @ ones
                    continue
                have -= query
                found[part] = (np.square if self.metric == "l2" else np.abs)(have, out=have) @ ones
            found = np.sqrt(found) if self.metric == "l2" else np.maximum(0, 1 - found) if self.metric == "cosine" else found
            found = found.astype(np.float32)
        found[np.isnan(found)] = np.inf
        return found

    def _exact(self, query: np.ndarray, nodes) -> np.ndarray:
        found = exact_rows(self.metric, query, self.vectors[nodes])
        return np.where(np.isnan(found), np.inf, found)

    # -- search -------------------------------------------------------------------------
    def _places(self, nodes: np.ndarray) -> np.ndarray:
        """Where the links of some nodes are, in turn."""
        sizes = self._degrees[nodes]
        ends = np.cumsum(sizes)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(self._starts[nodes] - (ends - sizes), sizes)

    def _beams(self, queries: np.ndarray, ef: int, without: np.ndarray | None = None) -> np.ndarray:
        """For every query, the ``ef`` best nodes that its beam reaches, by distance, as numbers: bits of the distance, node, 0.

        Unused places hold ``_NONE``. Odd numbers are nodes that the beam has not yet looked at from.
        """
        count, width = self.count, min(ef, self.count)
        beams = np.full((len(queries), width), _NONE)
        if not width or not len(queries):
            return beams
        asked, every = self._asked(queries), np.arange(len(queries))
        seen = np.zeros(len(queries) * count, dtype=bool)
        seen[every * count] = True
        if without is not None:
            seen[every * count + without] = True
        stamps = np.empty(len(seen), dtype=np.int32)  # read only where just written
        beams[:, 0] = self._numbers(self._keys(asked, every, every * 0), every * 0)
        together, going = max(LEAST_TOGETHER, ef // 16), every
        while True:
            have = beams[going]
            fresh = (have & 1).astype(bool)
            fresh &= have != _NONE
            now = fresh & (np.cumsum(fresh, axis=1, dtype=np.int32) <= together)
            if not (more := now.any(axis=1)).all():
                going, have, now = going[more], have[more], now[more]
            if not len(going):
                break
            row, place = np.nonzero(now)
            nodes = (have[row, place] & 0xFFFFFFFF) >> 1
            have[row, place] -= 1
            met = self._links[self._places(nodes)]
            spot = np.repeat(going[row] * count, self._degrees[nodes])
            spot += met
            spot = spot[~seen[spot]]
            stamp = np.arange(len(spot), dtype=np.int32)
            stamps[spot] = stamp
            spot = spot[stamps[spot] == stamp]  # a node may be met from several
            seen[spot] = True
            who = spot // count
            met = spot - who * count
            numbers = self._numbers(self._keys(asked, who, met), met)
            row = np.searchsorted(going, who) if len(going) < len(queries) else who
            closer = numbers < have[row, -1]  # a beam that is not full ends with _NONE
            numbers, row = numbers[closer], row[closer]
            sizes = np.bincount(row, minlength=len(going))
            added = np.full((len(going), sizes.max(initial=0)), _NONE)
            added[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = numbers
            have = np.concatenate([have, added], axis=1)
            have.sort(axis=1)
            beams[going] = have[:, :width]
        if without is not None:  # only the entry is in a beam although it is left out
            beams[(without == 0)[:, None] & ((beams & 0xFFFFFFFF) >> 1 == 0)] = _NONE
            beams.sort(axis=1)
        return beams

    @staticmethod
    def _numbers(distances: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Distance, node and a mark in one number, in the order of distance, then node."""
        return (distances.view(np.int32).astype(np.int64) << 32) | (nodes << 1) | 1

    def search_all(self, queries: np.ndarray, ef: int, depth: int | None = None, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every query, nodes and double distances of the ``ef`` best that a beam of that width reaches, ascending, NaN last, ``depth`` at most.

        One node of each query may be left out as if it had no node.
        """
        found, step = [], max(1, GROUP_MARKS // max(1, self.count))
        unsure = 1 + (self.vectors.shape[1] + 16) * 2 * np.finfo(np.float32).eps
        for begin in range(0, len(queries), step):
            part = queries[begin : begin + step]
            beams = self._beams(part, ef, None if without is None else without[begin : begin + step])
            reached = (beams != _NONE).sum(axis=1)
            if depth is not None and depth < beams.shape[1]:  # those that single precision does not put behind
                distances = (beams >> 32).astype(np.int32).view(np.float32)
                reached = np.minimum(reached, (distances <= distances[:, depth - 1 : depth] * unsure + 1e-12).sum(axis=1))
            nodes = (beams & 0xFFFFFFFF) >> 1
            for query, own, size in zip(part, nodes, reached.tolist(), strict=True):
                d = exact_rows(self.metric, query, self.vectors[own[:size]])
                order = np.lexsort((own[:size], d))[:depth]  # NaN comes last
                found.append((own[order], d[order]))
        return found

    def search(self, query: np.ndarray, ef: int, without: int | None = None) -> list[tuple[float, int]]:
        """``search_all`` of one query, as pairs of distance and node."""
        nodes, d = self.search_all(np.asarray(query, dtype=np.float64)[None], ef, None, None if without is None else np.array([without]))[0]
        return list(zip(d.tolist(), nodes.tolist(), strict=True))

    def beam_for(self, recall: float, sample: int = 64, k: int = 10) -> int:
        """The least of 32, 48, 64, 96 and so on whose beam finds that share of the k nearest of some nodes, spread over the graph, that are left out meanwhile.

        The sample is of a fixed size; a beam of all nodes is the most.
        """
        count, beam = len(self.vectors), 32
        chosen = np.unique(np.linspace(0, count - 1, min(count, sample)).astype(int)) if count > beam else np.zeros(0, dtype=int)
        best = []
        for node in chosen.tolist():
            d = self._exact(self.vectors[node], slice(None))
            d[node] = np.inf
            best.append(set(np.lexsort((np.arange(count), d))[:k].tolist()))
        while beam < count:
            found = self.search_all(self.vectors[chosen], beam, k, chosen)
            if sum(len(own & set(nodes.tolist())) for own, (nodes, _) in zip(best, found, strict=True)) >= recall * k * len(best):
                break
            beam += beam // 2 if beam & (beam - 1) == 0 else beam // 3
        return beam

    # -- build --------------------------------------------------------------------------
    def _diverse(self, near_first: list[tuple[float, int]], most: int) -> list[int]:
        """All candidates when they are few; else those that no kept node is closer to than the centre is."""
        if len(near_first) < most:
            return [node for _, node in near_first]
        kept: list[int] = []
        for d, node in near_first:
            if len(kept) >= most:
                break
            if not kept or not (self._exact(self.vectors[node], kept) < d).any():
                kept.append(node)
        return kept

    def _add(self, size: int) -> None:
        """The next nodes: beams over the graph as it is, and those of them that come before."""
        first, news = self.count, np.arange(self.count, self.count + size)
        step = max(1, GROUP_MARKS // first)
        beams = np.concatenate([self._beams(self.vectors[news[at : at + step]], self.efconstruction) for at in range(0, size, step)])
        if size > 1:
            later, earlier = np.tril_indices(size, -1)
            own = np.full((size, size), _NONE)
            own[later, earlier] = self._numbers(self._keys(self._asked(self.vectors[news]), later, news[earlier]), news[earlier])
            beams = np.concatenate([beams, own], axis=1)
            beams.sort(axis=1)
            beams = beams[:, : self.efconstruction]
        used = beams != _NONE
        nodes = (beams & 0xFFFFFFFF) >> 1
        if beams.shape[1] >= self.m:  # more than a node may have: the diverse ones
            for i in np.flatnonzero(used.sum(axis=1) >= self.m).tolist():
                d = self._exact(self.vectors[news[i]], nodes[i][used[i]])
                order = np.lexsort((nodes[i][used[i]], d))
                kept = self._diverse([(float(d[x]), int(nodes[i][x])) for x in order.tolist()], self.m)
                used[i] &= np.isin(nodes[i], kept)
        row, place = np.nonzero(used)
        self._link(news[row], nodes[row, place])
        self.count += size
        self._link(nodes[row, place], news[row])

    def _link(self, nodes: np.ndarray, others: np.ndarray) -> None:
        """Put others into the lists of nodes; a list of more than ``2 * m`` is pruned."""
        order = np.argsort(nodes, kind="stable")
        nodes, others = nodes[order], others[order]
        starts = np.flatnonzero(np.diff(nodes, prepend=-1))
        owners, sizes = nodes[starts], np.diff(starts, append=len(nodes))
        full = self._degrees[owners] + sizes > 2 * self.m
        fits = np.repeat(~full, sizes)
        need = int((self._degrees[owners] + sizes)[~full].max(initial=0))
        if need > self._width or (full.any() and self._width < 2 * self.m):
            self._widen(2 * self.m if full.any() else min(2 * self.m, max(need, 2 * self._width)))
        place = self._degrees[nodes] + np.arange(len(nodes)) - np.repeat(starts, sizes)
        self._links[(self._starts[nodes] + place)[fits]] = others[fits]
        self._degrees[owners[~full]] += sizes[~full]
        for owner, start, size in zip(owners[full].tolist(), starts[full].tolist(), sizes[full].tolist(), strict=True):
            begin = self._starts[owner]
            have = np.concatenate([self._links[begin : begin + self._degrees[owner]], others[start : start + size]])
            d = self._exact(self.vectors[owner], have)
            order = np.lexsort((have, d))
            kept = self._diverse([(float(d[i]), int(have[i])) for i in order.tolist()], 2 * self.m)
            self._links[begin : begin + len(kept)] = kept
            self._degrees[owner] = len(kept)

    def _widen(self, width: int) -> None:
        table = np.zeros((len(self.vectors), width), dtype=np.int32)
        table[:, : self._width] = self._links.reshape(len(self.vectors), self._width)
        self._links, self._width, self._starts = table.reshape(-1), width, np.arange(len(self.vectors)) * width
