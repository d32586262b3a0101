"""A linear-chain conditional random field over dense features, or numbers of features that a place has, in numpy."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def unary(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Log potentials of each place: of dense features, or of whole numbers that name features (0: none)."""
    return weights[x].sum(axis=-2) if x.dtype.kind == "i" else x @ weights


@dataclass
class Chain:
    """weights: features by states; moves: log potential of each state after each."""

    weights: np.ndarray
    moves: np.ndarray

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """Forward-backward over one sequence: P(state) at each place."""
        own = unary(self.weights, x)
        n, k = own.shape
        fore, back = np.empty((n, k)), np.zeros((n, k))
        fore[0] = own[0]
        for t in range(1, n):
            fore[t] = own[t] + _lse(fore[t - 1][:, None] + self.moves, 0)
        for t in range(n - 2, -1, -1):
            back[t] = _lse(self.moves + own[t + 1] + back[t + 1], 1)
        both = fore + back
        both -= both.max(axis=1, keepdims=True)
        p = np.exp(both)
        return p / p.sum(axis=1, keepdims=True)

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The likeliest states of one sequence; ties to the lower state."""
        own = unary(self.weights, x)
        n, k = own.shape
        if k == 2:  # plain numbers are several times faster than arrays of two
            (m00, m01), (m10, m11) = self.moves.tolist()
            rows = own.tolist()
            a, b = rows[0]
            came = []
            for u, v in rows[1:]:
                fa, fb = a + m00 < b + m10, a + m01 < b + m11
                came.append((fa, fb))
                a, b = u + (b + m10 if fa else a + m00), v + (b + m11 if fb else a + m01)
            state = int(b > a)
            out = [state]
            for pair in reversed(came):
                state = int(pair[state])
                out.append(state)
            return np.array(out[::-1])
        best, came = own[0], []
        for t in range(1, n):
            step = best[:, None] + self.moves
            came.append(step.argmax(axis=0))
            best = step.max(axis=0) + own[t]
        out = [int(best.argmax())]
        for c in reversed(came):
            out.append(int(c[out[-1]]))
        return np.array(out[::-1])


def fit(sequences: list[np.ndarray], labels: list[np.ndarray], width: int, states: int = 2, rounds: int = 200, rate: float = 0.1, l2: float = 1e-3) -> Chain:
    """Maximum conditional likelihood by Adam over all sequences of `width` features (dense, or numbers below width) at once, padded to the longest. Without any, all potentials are 0."""
    chain = Chain(np.zeros((width, states)), np.zeros((states, states)))
    if not sequences:
        return chain
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
    groups = []
    for i in range(0, len(order), 256):
        own = order[i : i + 256]
        n = max(len(sequences[j]) for j in own)
        x, y, mask = np.zeros((len(own), n, sequences[0].shape[1]), sequences[0].dtype), np.zeros((len(own), n), int), np.zeros((len(own), n), bool)
        for r, j in enumerate(own):
            k = len(sequences[j])
            x[r, :k], y[r, :k], mask[r, :k] = sequences[j], labels[j], True
        groups.append((x, y, mask))
    total = sum(len(s) for s in sequences)
    params = [chain.weights, chain.moves]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        grads = [l2 * p for p in params]
        for x, y, mask in groups:
            gw, gm = _gradient(chain, x, y, mask)
            grads[0] -= gw / total
            grads[1] -= gm / total
        for p, g, a, b in zip(params, grads, m, v):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return chain


def _gradient(chain: Chain, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Observed minus expected feature and move counts."""
    own = unary(chain.weights, x)
    b, n, k = own.shape
    fore, back = np.zeros((b, n, k)), np.zeros((b, n, k))
    fore[:, 0] = own[:, 0]
    for t in range(1, n):
        step = own[:, t] + _lse(fore[:, t - 1, :, None] + chain.moves, 1)
        fore[:, t] = np.where(mask[:, t, None], step, fore[:, t - 1])
    for t in range(n - 2, -1, -1):
        step = _lse(chain.moves + (own[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        back[:, t] = np.where(mask[:, t + 1, None], step, 0)
    z = _lse(fore[:, -1], 1)
    p = np.exp(fore + back - z[:, None, None]) * mask[..., None]
    seen = np.eye(k)[y] * mask[..., None]
    if x.dtype.kind == "i":
        off = (seen - p).reshape(-1, k)
        gw = np.stack([np.bincount(x.ravel(), np.repeat(off[:, s], x.shape[2]), len(chain.weights)) for s in range(k)], axis=1)
        gw[0] = 0
    else:
        gw = np.einsum("bnd,bnk->dk", x, seen - p)
    gm = np.zeros((k, k))
    for t in range(1, n):
        ok = mask[:, t]
        if not ok.any():
            break
        pair = np.exp(fore[ok, t - 1, :, None] + chain.moves + (own[ok, t] + back[ok, t])[:, None, :] - z[ok, None, None])
        gm += np.einsum("bi,bj->ij", seen[ok, t - 1], seen[ok, t]) - pair.sum(axis=0)
    return gw, gm


#: Stretches of equal potentials from this length on are done in closed form.
LONG_RUN = 24


def flat_runs(own: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(state 1) at each place of a chain of two states by forward-backward; own: log potential of state 1 over state 0 at each place.

    Messages are kept as ratios of the two states. Long stretches of equal potentials are done in closed form, by powers of one 2 by 2
    matrix; so a long text with few places that differ costs a few steps, and the result is that of the step-by-step pass.
    """
    n = len(own)
    if not n:
        return np.zeros(0)
    (m00, m01), (m10, m11) = np.exp(moves - moves.max()).tolist()
    cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1])).tolist()
    stretches = list(zip(cuts, [*cuts[1:], n]))
    local = np.exp(own[cuts]).tolist()

    def powers(a: float, b: float, c: float, d: float, ratio: float, steps: int) -> np.ndarray:
        """Ratios of [[a, b], [c, d]]^t (1, ratio) for t from 1 to steps."""
        half, root = (a + d) / 2, math.sqrt(((a - d) / 2) ** 2 + b * c)  # all entries are positive: two real values
        large, small = half + root, half - root
        # (1, ratio) = x + y with matrix x = large x, matrix y = small y
        x0, x1 = (a + b * ratio - small) / (2 * root), (c + d * ratio - small * ratio) / (2 * root)
        shrunk = np.power(small / large, np.arange(1, steps + 1))
        return (x1 + shrunk * (ratio - x1)) / (x0 + shrunk * (1 - x0))

    fore = np.empty(n)
    ratio = -1.0
    for (lo, hi), e in zip(stretches, local):
        if ratio < 0:
            fore[lo] = ratio = e
            lo += 1
        if hi - lo >= LONG_RUN:
            fore[lo:hi] = powers(m00, m10, e * m01, e * m11, ratio, hi - lo)
            ratio = float(fore[hi - 1])
        else:
            for t in range(lo, hi):
                ratio = e * (m01 + m11 * ratio) / (m00 + m10 * ratio)
                fore[t] = ratio
    back = np.empty(n)  # the message that comes from what follows
    ratio = 1.0
    for (lo, hi), e in zip(reversed(stretches), reversed(local)):
        back[hi - 1] = ratio
        if hi - lo >= LONG_RUN:
            got = powers(m00, m01 * e, m10, m11 * e, ratio, hi - lo)
            back[lo : hi - 1] = got[-2::-1]
            ratio = float(got[-1])
        else:
            for t in range(hi - 1, lo - 1, -1):
                back[t] = ratio
                ratio = (m10 + m11 * e * ratio) / (m00 + m01 * e * ratio)
    odds = fore * back
    return odds / (1 + odds)
