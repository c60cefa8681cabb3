"""The chunked computation in plain Python, step by step, for comparison."""

from __future__ import annotations

import numpy as np


def d2(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def init(x, k, first):
    chosen = [first]
    for _ in range(k - 1):
        best, far = None, 0.0
        for j, p in enumerate(x):
            if j not in chosen:
                near = min(d2(p, x[c]) for c in chosen)
                if near > far:
                    best, far = j, near
        chosen.append(best)
    return chosen


def nearest(x, centers):
    out = []
    for p in x:
        best, near = -1, float("inf")
        for j, c in enumerate(centers):
            d = d2(p, c)
            if d < near:
                best, near = j, d
        out.append(best)
    return out


def means(x, cluster, k):
    out = []
    for j in range(k):
        own = [p for p, c in zip(x, cluster) if c == j]
        out.append([sum(v) / len(own) for v in zip(*own)] if own else [float("nan")] * len(x[0]))
    return out


def lloyd(x, centers, passes=150):
    k = len(centers)
    now = was = nearest(x, centers)
    best, done = float("inf"), 0
    while done < passes:
        centers = means(x, now, k)
        total = sum(d2(p, centers[c]) for p, c in zip(x, now))
        if total > best:
            return means(x, was, k), was, done
        was, now = now, nearest(x, centers)
        if was == now:
            break
        best, done = total, done + 1
    return centers, now, done


def chunked(x, k, t):
    n, m = len(x), len(x) // t
    centers, var, owner = [], [], []
    for c in range(m):
        part = x[c * t : (c + 1) * t]
        found, cluster, _ = lloyd(part, [part[i] for i in init(part, k, c + 1)])
        centers += found
        var += [sum(d2(p, found[j]) for p, q in zip(part, cluster) if q == j) / t for j in range(k)]
        owner += [c * k + q for q in cluster]
    group, g = {}, 0
    for j in range(k * m):
        if j in group:
            continue
        group[j] = g
        for i in range(j + 1, k * m):
            if i not in group and d2(centers[j], centers[i]) < var[j]:
                group[i] = g
        g += 1
    members = [[r for r, c in enumerate(owner) if group[c] == i] for i in range(g)]
    quota = [int(np.float32(np.float32(len(q)) / np.float32(n)) * np.float32(t)) for q in members]
    picks = []
    while len(picks) < t:
        for i in range(g):
            for j in range(quota[i]):
                if len(picks) < t:
                    picks.append(members[i][(j + i * quota[i]) % len(members[i])])
    rows = [r for _, _, r in sorted((r // t, o, r) for o, r in enumerate(picks))]
    last = [x[r] for r in rows]
    final, cluster, done = lloyd(last, [last[i] for i in init(last, k, m + 1)])
    return {"groups": group, "quota": quota, "rows": rows, "centers": final, "iterations": done}
