"""Plain Python versions, by loops over a list of rows."""

from itertools import combinations


def windows(rows, n, bad):
    """First indexes of unbroken windows for which ``bad(window)`` holds."""
    out = []
    for i in range(len(rows) - n + 1):
        w = rows[i : i + n]
        whole = all(w[0][c] == w[-1][c] for c in ("year", "month", "day", "pass"))
        if whole and w[-1]["iteration"] - w[0]["iteration"] + 1 == n and bad(w):
            out.append(i)
    return out


def candidates(rows, flagged, lag):
    out = set()
    for i, r in enumerate(rows):
        for w in range(i, min(len(rows), i + lag + 1)):
            same = all(r[c] == rows[w][c] for c in ("year", "month", "day", "pass"))
            if w in flagged and same and rows[w]["iteration"] - r["iteration"] <= lag:
                out.add(i)
    return out


def mine(rows, flagged, dims, length, lag, support, k_threshold):
    """{(text or None of each dimension): (cnt, join, distinct, k)} by explicit enumeration."""
    n, flagged = len(rows), set(flagged)
    near = candidates(rows, flagged, lag)
    subsets = [c for size in range(1, len(dims) + 1) for c in combinations(dims, size)]
    count = {}
    for i in range(n - length + 1):
        joins = sum(w in flagged for w in range(i, i + lag + 1))
        for s in subsets:
            key = tuple(" ".join(str(r[d]) for r in rows[i : i + length]) if d in s else None for d in dims)
            c = count.setdefault(key, [0, 0, 0, False])
            c[0] += 1
            c[1] += joins
            c[2] += joins > 0
            c[3] |= i in near
    out = {}
    for key, (cnt, join, distinct, cand) in count.items():
        if cand and flagged and cnt / n >= support:
            k = float(n * join) / (float(cnt) * len(flagged))
            if k > k_threshold:
                out[key] = (cnt, join, distinct, k)
    return out
