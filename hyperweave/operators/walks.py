"""The walk of ``ordering.feed_forward_order`` within components of hyperedges, in tasks."""

from __future__ import annotations

import heapq
import math
from array import array

import numpy as np
import pyarrow as pa

#: Rows of a batch of places.
ROWS = 1 << 16


def walked(batches):
    """(low, head, nth, v) of the components in rows (root, kind, e, v, is_src, w), sorted by (root, kind, e).

    Rows of kind 0 are a component's nodes (e = v), is_src whether seeds reach it, with weight w; rows of kind 1 are its pins. A run goes on while
    what is taken is stronger than its head; ``low`` is the head's negative priority, ``nth`` a node's place in its component.
    """
    root, held = None, None
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("root", "kind", "e", "v", "is_src", "w")]
        ids = columns[0]
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held is None or ids[a] != root:
                if held is not None:
                    yield from held.rows()
                root, held = ids[a], Component()
            held.add(*(c[a:b] for c in columns[1:]))
    if held is not None:
        yield from held.rows()


class Component:
    """Rows of one component as they come, in arrays that grow in place: 5 bytes a pin, 16 a hyperedge."""

    def __init__(self):
        self.nodes: list[tuple[np.ndarray, ...]] = []
        self.names = None
        self.at, self.src, self.bounds, self.w, self.last = array("i"), bytearray(), array("q"), array("d"), None

    def add(self, kind, e, v, is_src, w) -> None:
        n = int(np.searchsorted(kind, 1))
        if n:
            self.nodes.append((v[:n].copy(), is_src[:n].astype(bool), w[:n].astype(float)))
        if n == len(kind):
            return
        if self.names is None:
            self._named()
        e, v, is_src, w = e[n:], v[n:], is_src[n:].astype(bool), w[n:].astype(float)
        new = np.append(e[0] != self.last, np.diff(e) != 0)
        self.bounds.frombytes((np.flatnonzero(new) + len(self.at)).astype(np.int64).tobytes())
        self.w.frombytes(w[new].tobytes())
        self.at.frombytes(np.searchsorted(self.names, v).astype(np.int32).tobytes())
        self.src += is_src.tobytes()
        self.last = e[-1]

    def _named(self) -> None:
        self.names, self.reached, self.start = (np.concatenate(c) for c in zip(*self.nodes))
        self.nodes = []

    def _fired(self) -> tuple[array, array]:
        """The hyperedges that each node is a source of, node after node, and where each node's begin."""
        pins = np.flatnonzero(np.frombuffer(self.src, bool))
        self.src = bytearray()
        hedge = (np.searchsorted(np.frombuffer(self.bounds, np.int64), pins, "right") - 1).astype(np.int32)
        by = np.frombuffer(self.at, np.int32)[pins]
        del pins
        order = np.argsort(by, kind="stable")
        starts = np.append(0, np.cumsum(np.bincount(by, minlength=len(self.names))))
        return array("i", hedge[order].tobytes()), array("q", starts.astype(np.int64).tobytes())

    def rows(self):
        if self.names is None:
            self._named()
        (fired, starts), names, w, at, bounds = self._fired(), self.names, self.w, self.at, self.bounds
        bounds.append(len(at))
        priority = array("d", np.where(self.reached, self.start, 0.0).tobytes())
        state = bytearray(self.reached.tobytes())  # 1: reached, 2: placed
        most, low, head, nth = 2 * len(names) + 1024, -math.inf, -1, 0
        lows, heads, placed = array("d"), array("i"), array("i")
        heap = self._open(state, priority)
        while heap:
            p, i = heapq.heappop(heap)
            if state[i] == 2 or -p != priority[i]:
                continue
            state[i] = 2
            if (p, i) > (low, head):
                low, head = p, i
            lows.append(low)
            heads.append(head)
            placed.append(i)
            if len(placed) >= ROWS:
                yield self._batch(lows, heads, placed, nth)
                nth += len(placed)
                lows, heads, placed = array("d"), array("i"), array("i")
            raised = set()
            for h in fired[starts[i] : starts[i + 1]]:
                by_w = w[h]
                for u in at[bounds[h] : bounds[h + 1]]:
                    if state[u] != 2:
                        priority[u] += by_w
                        state[u] = 1
                        raised.add(u)
            for u in raised:
                heapq.heappush(heap, (-priority[u], u))
            if len(heap) > most:  # most of them are out of date
                heap = self._open(state, priority)
        if placed:
            yield self._batch(lows, heads, placed, nth)

    @staticmethod
    def _open(state: bytearray, priority: array) -> list[tuple[float, int]]:
        heap = [(-priority[i], i) for i in np.flatnonzero(np.frombuffer(state, np.uint8) == 1).tolist()]
        heapq.heapify(heap)
        return heap

    def _batch(self, lows: array, heads: array, placed: array, nth: int) -> pa.RecordBatch:
        named = lambda x: pa.array(self.names[np.frombuffer(x, np.int32)], pa.int64())
        return pa.record_batch([pa.array(np.frombuffer(lows, float)), named(heads), pa.array(np.arange(nth, nth + len(placed))), named(placed)], ["low", "head", "nth", "v"])
