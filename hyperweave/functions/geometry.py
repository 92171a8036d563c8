"""Lattice geometry: convex hulls and spanning trees under the Manhattan distance."""

from __future__ import annotations

from math import gcd

import numpy as np


def hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Corners of the convex hull, counter-clockwise (monotone chain)."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[tuple[int, int]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def hull_points(points: list[tuple[int, int]]) -> int:
    """Lattice points in or on the hull: area + border / 2 + 1 (Pick's theorem)."""
    corners = hull(points)
    if len(corners) < 2:
        return len(corners)
    edges = list(zip(corners, corners[1:] + corners[:1]))
    border = sum(gcd(abs(b[0] - a[0]), abs(b[1] - a[1])) for a, b in edges)
    twice = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in edges))
    if not twice:  # a line, walked there and back
        return border // 2 + 1
    return (twice + border) // 2 + 1


def tree_span(points: list[tuple[int, int]]) -> int:
    """Length of a minimum spanning tree (Prim, one vector operation per point)."""
    at = np.array(sorted(set(points)), np.int64).reshape(-1, 2)
    if len(at) < 2:
        return 0
    far = np.iinfo(np.int64).max
    dist = np.abs(at - at[0]).sum(axis=1)
    done = np.zeros(len(at), bool)
    done[0], total = True, 0
    for _ in range(len(at) - 1):
        k = int(np.argmin(np.where(done, far, dist)))
        total += int(dist[k])
        done[k] = True
        dist = np.minimum(dist, np.abs(at - at[k]).sum(axis=1))
    return total
