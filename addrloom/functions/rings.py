"""Polygons as lists of rings of (x, y), the first the outer one: cutting at a line parallel to an axis, area, bounds.

Points on the line belong to the low side, so the two sides share no point and lose none.
"""

from __future__ import annotations

Ring = list[tuple[float, float]]
QUARTERS = ("SW", "SE", "NW", "NE")


def signed_area(ring: Ring) -> float:
    x0, y0 = ring[0]
    return sum((ax - x0) * (by - y0) - (bx - x0) * (ay - y0) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1])) / 2


def area(rings: list[Ring]) -> float:
    return abs(signed_area(rings[0])) - sum(abs(signed_area(r)) for r in rings[1:])


def bounds(rings: list[Ring]) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
    return min(xs), min(ys), max(xs), max(ys)


def within(rings: list[Ring], x: float, y: float) -> bool:
    """Even-odd rule over all rings."""
    odd = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def _tidy(ring: Ring) -> Ring | None:
    """Without repeated points; None if nothing of it has an area."""
    ring = [p for p, q in zip(ring, ring[-1:] + ring[:-1]) if p != q]
    return ring if len(ring) > 2 and abs(signed_area(ring)) > 1e-18 else None


def cut(rings: list[Ring], axis: int, at: float) -> tuple[list[list[Ring]], list[list[Ring]]]:
    """The polygons that lie at or below ``at`` on the axis, and those above it.

    Each ring is taken apart where it crosses the line. Sorted along the line, crossings pair up two by two: between the
    first and the second lies the inside, from the second to the third the outside, and so on. Where crossings share
    a place, the one whose edge leads further back on the high side comes first.
    """
    whole: tuple[list[Ring], list[Ring]] = ([], [])
    crossings: list[tuple[float, float]] = []
    chains: tuple[list, list] = ([], [])  # (first crossing, points, last crossing)
    for ring in rings:
        high = [p[axis] > at for p in ring]
        if all(high) or not any(high):
            whole[high[0]].append(ring)
            continue
        n = len(ring)
        begin = next(i for i in range(n) if high[i] != high[i - 1])
        started, first, points = None, len(crossings), []
        for i in [*range(begin, n), *range(begin + 1)]:
            if high[i] != high[i - 1]:
                lo, hi = (ring[i - 1], ring[i]) if high[i] else (ring[i], ring[i - 1])
                lean = (hi[1 - axis] - lo[1 - axis]) / (hi[axis] - lo[axis])
                here = first if started is not None and i == begin else len(crossings)
                if here == len(crossings):
                    crossings.append((lo[1 - axis] + (at - lo[axis]) * lean if lo[axis] < at else lo[1 - axis], lean))
                if started is not None:
                    chains[high[i - 1]].append((started, points, here))
                started, points = here, []
            points.append(ring[i])
    order = sorted(range(len(crossings)), key=crossings.__getitem__)
    partner = {a: b for i in range(0, len(order), 2) for a, b in (order[i : i + 2], order[i : i + 2][::-1])}
    on_line = [(c, at) if axis else (at, c) for c, _ in crossings]

    out: tuple[list[list[Ring]], list[list[Ring]]] = ([], [])
    for side in (0, 1):
        ends = {c: k for k, (a, _, b) in enumerate(chains[side]) for c in (a, b)}
        used: set[int] = set()
        for k in range(len(chains[side])):
            ring, c = [], chains[side][k][0]
            while ends[c] not in used:
                used.add(ends[c])
                a, points, b = chains[side][ends[c]]
                forth = c == a
                ring += [on_line[c], *(points if forth else points[::-1]), on_line[b if forth else a]]
                c = partner[b if forth else a]
            if ring and (ring := _tidy(ring)):
                out[side].append([ring])
        holes = list(whole[side])
        if holes and holes[0] is rings[0]:
            out[side].append([holes.pop(0)])
        for h in holes:
            own = [p for p in out[side] if within(p[:1], *h[0])] or out[side]
            own[0].append(h)
    return out


def quarters(rings: list[Ring]) -> tuple[float, float, dict[str, list[list[Ring]]]]:
    """The middle of the bounds and the polygons in each quarter, from the lowest, then westernmost point on."""
    x0, y0, x1, y1 = bounds(rings)
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    found: dict[str, list[list[Ring]]] = {q: [] for q in QUARTERS}
    for east, half in enumerate(cut(rings, 0, cx)):
        for piece in half:
            for north, parts in enumerate(cut(piece, 1, cy)):
                found[QUARTERS[2 * north + east]] += parts
    return cx, cy, {q: sorted(p, key=lambda r: min((y, x) for x, y in r[0])) for q, p in found.items()}
