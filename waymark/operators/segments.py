"""The nearest of a block of segments for each of a block of places, in arrays."""

from __future__ import annotations

import numpy as np

from waymark.functions import geometry as G

#: (segment, strip) rows and pairs that are held at once.
ROWS, PAIRS = 125_000, 250_000
#: Keys of one strip: more than places in degrees * 1e7 lie apart.
SPAN = 1 << 33


def segment_m(y: np.ndarray, x: np.ndarray, k: np.ndarray, ay: np.ndarray, ax: np.ndarray, by: np.ndarray, bx: np.ndarray) -> np.ndarray:
    """geometry.segment_m, operation by operation, so that both give the same doubles; k is its scale of longitudes."""
    ax, ay = (ax - x) / G.SCALE * G.DEGREE_M * k, (ay - y) / G.SCALE * G.DEGREE_M
    bx, by = (bx - x) / G.SCALE * G.DEGREE_M * k, (by - y) / G.SCALE * G.DEGREE_M
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = np.where(length > 0, np.maximum(0.0, np.minimum(1.0, -(ax * dx + ay * dy) / np.where(length > 0, length, 1.0))), 0.0)
    px, py = ax + t * dx, ay + t * dy
    return np.sqrt(px * px + py * py)


def _pieces(n: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of n whose sums are about `most`; zeros at the end may be left out."""
    if not n.any():
        return []
    ends = np.cumsum(n)
    cuts = np.unique(np.minimum(np.searchsorted(ends, np.arange(most, ends[-1] + most, most)) + 1, len(n)))
    return list(zip([0, *cuts[:-1]], cuts, strict=True))


def _spread(n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i repeated n[i] times, first[i], first[i] + 1, ...)."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _by_direction(dy: np.ndarray, dx: np.ndarray, places: int) -> list[tuple[np.ndarray, float, float]]:
    """(segments, sine and cosine of their mean direction) of each class of like directions. More classes make runs through
    the places shorter, but each sorts the places anew."""
    turn = np.mod(np.arctan2(dy, dx), np.pi)
    n = int(np.clip((len(dy) / np.sqrt(places)) ** (2 / 3) / 6, 1, min(64, 1 + len(dy) // 2_000)))
    out = []
    for own in np.array_split(np.argsort(turn, kind="stable"), n):
        # a direction and its opposite are one, so twice the angles are averaged
        mean = np.arctan2(np.sin(2 * turn[own]).sum(), np.cos(2 * turn[own]).sum()) / 2
        out.append((own, float(np.sin(mean)), float(np.cos(mean))))
    return out


def nearest_segments(y: np.ndarray, x: np.ndarray, k: np.ndarray, within: np.ndarray, idx: np.ndarray, ay: np.ndarray, ax: np.ndarray, by: np.ndarray, bx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place (y, x in degrees * 1e7) the idx and the metres of the nearest segment at most `within` metres away, ties
    to the smaller idx; metres are infinite where there is none. Exact.

    Segments of like directions go together, and so do places of like bounds. For each class of directions the places lie in
    strips along the mean direction, of as many places each, sorted along the strip. Of a segment, the part in a strip, widened
    by the strip's largest bound, covers a run of that order; bounds shrink on the way. A segment that is nearly parallel to
    the strips meets few of them, so they can be narrow."""
    best, who = np.full(len(y), np.inf), np.full(len(y), np.iinfo(np.int64).max)
    if len(idx) and len(y):
        y, x, ay, ax, by, bx = (v.astype(np.float64) for v in (y, x, ay, ax, by, bx))
        limit = within.astype(np.float64)
        kind = np.floor(np.log2(limit / G.DEGREE_M * G.SCALE / k + 1.0) / 2).astype(np.int64)
        kinds = [np.flatnonzero(kind == one) for one in np.unique(kind)]
        for like, sine, cosine in _by_direction(by - ay, bx - ax, len(y)):
            ends = [v[like] for v in (ay, ax, by, bx)]
            for own in kinds:
                _meet(own, y, x, k, limit, best, who, idx[like], *ends, sine, cosine)
    return np.where(np.isfinite(best), who, -1), best


def _meet(own: np.ndarray, y: np.ndarray, x: np.ndarray, k: np.ndarray, bound: np.ndarray, best: np.ndarray, who: np.ndarray, idx: np.ndarray, ay: np.ndarray, ax: np.ndarray, by: np.ndarray, bx: np.ndarray, sine: float, cosine: float) -> None:
    """Brings bound, best and who of the places `own` up to date with segments of about one direction."""
    y0, x0 = y[own[0]], x[own[0]]
    across = lambda y, x: (y - y0) * cosine - (x - x0) * sine
    along = lambda y, x: (x - x0) * cosine + (y - y0) * sine
    sv, su, ev, eu = across(ay, ax), along(ay, ax), across(by, bx), along(by, bx)
    up = sv <= ev  # for clipping; distances are taken from the ends as they came
    sv, su, ev, eu = np.where(up, sv, ev), np.where(up, su, eu), np.where(up, ev, sv), np.where(up, eu, su)
    slope = np.where(ev > sv, (eu - su) / np.where(ev > sv, ev - sv, 1.0), 0.0)
    V, U = across(y[own], x[own]), along(y[own], x[own])
    # strips that a segment crosses cost about four times what a pair does
    crossed = (ev - sv).mean() / (np.ptp(V) + 1)
    run = np.abs(eu - su).mean() / (np.ptp(U) + 1)
    n = int(np.clip(np.sqrt(len(own) * (run + 1e-3) / (crossed + 1e-9)) / 2, 1, 1 + len(own) // 16))
    strip = np.empty(len(own), np.int64)
    strip[np.argsort(V, kind="stable")] = np.arange(len(own)) * n // len(own)
    u0 = U.min()
    keys = strip * SPAN + (U - u0).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    own, keys, V = own[order], keys[order], V[order]
    Y, X, K, limit, found_m, found_i = y[own], x[own], k[own], bound[own], best[own], who[own]
    starts = np.searchsorted(strip[order], np.arange(n))
    low, high = np.minimum.reduceat(V, starts), np.maximum.reduceat(V, starts)
    # neighbours one after another look into neighbouring strips
    turn = np.argsort(sv, kind="stable")
    sv, su, ev, eu, slope, idx, ay, ax, by, bx = (v[turn] for v in (sv, su, ev, eu, slope, idx, ay, ax, by, bx))
    group, changed = 65_536, True
    for g in range(0, len(idx), group):
        if changed:
            reach = limit / G.DEGREE_M * G.SCALE * (1 + 1e-6) + 1.0
            wide = np.maximum.reduceat(reach * (abs(cosine) / K + abs(sine)), starts)
            tall = np.maximum.reduceat(reach * (abs(cosine) + abs(sine) / K), starts)
            from_v, to_v = low - tall, high + tall
            upto, since = np.maximum.accumulate(to_v), np.minimum.accumulate(from_v[::-1])[::-1]
            changed = False
        at = slice(g, g + group)
        first = np.searchsorted(upto, sv[at], "left")
        count = np.maximum(0, np.searchsorted(since, ev[at], "right") - first)
        for head, tail in _pieces(count, ROWS):
            s, r = _spread(count[head:tail], first[head:tail])
            s += g + head
            a, b = np.maximum(from_v[r], sv[s]), np.minimum(to_v[r], ev[s])
            flat = ev[s] == sv[s]
            ua, ub = su[s] + (a - sv[s]) * slope[s], np.where(flat, eu[s], su[s] + (b - sv[s]) * slope[s])
            left, right = np.minimum(ua, ub) - wide[r] - u0, np.maximum(ua, ub) + wide[r] - u0
            i = np.searchsorted(keys, r * SPAN + np.clip(np.floor(left), 0, SPAN - 1).astype(np.int64), "left")
            j = np.searchsorted(keys, r * SPAN + np.clip(np.floor(right) + 1, -1, SPAN - 1).astype(np.int64), "right")
            pairs = np.where(a <= b, np.maximum(0, j - i), 0)
            some = np.flatnonzero(pairs)
            s, i, pairs = s[some], i[some], pairs[some]
            for lo, hi in _pieces(pairs, PAIRS):
                of, q = _spread(pairs[lo:hi], i[lo:hi])
                t = s[lo:hi][of]
                dx, dy, kq = bx[t] - ax[t], by[t] - ay[t], K[q]
                # from the line through a segment; one unit for rounding
                away = ((X[q] - ax[t]) * dy - (Y[q] - ay[t]) * dx) * kq
                far = limit[q] / G.DEGREE_M * G.SCALE * (1 + 1e-6) + 1.0
                kept = np.flatnonzero(away * away <= far * far * (dx * dx * kq * kq + dy * dy))
                q, t = q[kept], t[kept]
                m = segment_m(Y[q], X[q], K[q], ay[t], ax[t], by[t], bx[t])
                kept = np.flatnonzero(m <= limit[q])
                if len(kept):
                    q, t, m = q[kept], t[kept], m[kept]
                    order = np.lexsort((idx[t], m, q))
                    order = order[np.r_[True, q[order][1:] != q[order][:-1]]]
                    q, t, m = q[order], idx[t[order]], m[order]
                    better = (m < found_m[q]) | ((m == found_m[q]) & (t < found_i[q]))
                    q, t, m = q[better], t[better], m[better]
                    found_m[q], found_i[q], limit[q] = m, t, m
                    changed = True
    best[own], who[own], bound[own] = found_m, found_i, limit
