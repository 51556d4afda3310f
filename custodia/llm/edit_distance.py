"""Bounded edit distance by bit vectors over a diagonal band."""

from __future__ import annotations


def distance_within(a: str, b: str, k: int) -> int | None:
    """The edit distance of ``a`` and ``b`` if it is at most ``k``.

    Register ``r[d]`` holds one bit for each of the 2k+1 diagonals around
    the main one: whether that diagonal can be reached at the current
    character of ``b`` with at most ``d`` edits.
    """
    if abs(len(a) - len(b)) > k:
        return None
    start, stop = 0, min(len(a), len(b))
    while start < stop and a[start] == b[start]:
        start += 1
    cut = 0
    while cut < stop - start and a[-1 - cut] == b[-1 - cut]:
        cut += 1
    a, b = a[start:len(a) - cut], b[start:len(b) - cut]
    places: dict[str, int] = {}
    for n, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << n + k
    band = (1 << 2 * k + 1) - 1
    r = [((1 << d + 1) - 1) << k & band for d in range(k + 1)]
    for n, c in enumerate(b):
        match = places.get(c, 0) >> n & band
        new = [r[0] & match]
        for d in range(1, k + 1):
            new.append((r[d] & match | r[d - 1] | r[d - 1] >> 1 | new[d - 1] << 1) & band)
        r = new
        if not r[k]:
            return None
    end = 1 << len(a) - len(b) + k
    return next((d for d in range(k + 1) if r[d] & end), None)
