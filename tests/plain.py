"""Plain numpy versions of the order-based definitions, for comparison on small inputs."""

import hashlib

import numpy as np


def uniform(*parts):
    digest = hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()
    return int(digest[:13], 16) / 2**52


def weighted_quantile(values, weights, probs):
    order = np.argsort(values, kind="stable")
    v, cum = np.asarray(values, float)[order], np.cumsum(np.asarray(weights, float)[order])
    n = cum[-1]
    out = []
    for p in probs:
        position = 1 + (n - 1) * p
        low = min(max(np.floor(position), 1), n)
        high = min(max(np.floor(position), 1) + 1, n)
        share = position - np.floor(position)
        pick = [v[min(np.searchsorted(cum, c * (1 - 1e-12)), len(v) - 1)] for c in (low, high)]
        out.append((1 - share) * pick[0] + share * pick[1])
    return out


def running_weight(rows):
    """rows of (id, value, weight) to {id: inclusive running weight}."""
    total, out = 0.0, {}
    for i, _, w in sorted(rows, key=lambda r: (r[1], uniform(r[0], 0, "tie"), r[0])):
        total += w
        out[i] = total
    return out


def calibrate(rows, brackets, heirs, seed, most=100, percentile=0.95, alpha=1.5):
    """rows of (id, weight, p, value); brackets of (low, high, count, average) per heir."""
    ids = [r[0] for r in rows]
    w, p, v = (np.array([r[k] for r in rows], float) for k in (1, 2, 3))
    p = p * np.where(v * heirs > 1e6, 0.75, 1.0)
    for number, (low, high, target, average) in enumerate(brackets, start=1):
        inside = (v >= low) & (v < (np.inf if high is None else high))
        if not inside.any():
            continue
        count = (p * w)[inside].sum()
        if 0 < count < target:
            p[inside] = np.minimum(1, p[inside] * (target / count))
            count = (p * w)[inside].sum()
        wealth = (p * w * v)[inside].sum()
        if count > 0 and wealth / count < average:
            v[inside] = v[inside] * (average / (wealth / count))
        deficit = target - count
        if deficit > 1e-9 * target:
            candidates = np.flatnonzero((v < low) & (v >= np.quantile(v, percentile)))
            top = sorted(candidates, key=lambda k: (-v[k], ids[k]))[:most]
            if top:
                for k in top:
                    v[k] = average * (1 - uniform(ids[k], seed, f"promote{number}")) ** (-1 / alpha)
                headroom = ((1 - p) * w)[top].sum()
                if headroom > 0:
                    p[top] += min(1, deficit / headroom) * (1 - p[top])
    return {i: (pi, vi) for i, pi, vi in zip(ids, p, v)}
