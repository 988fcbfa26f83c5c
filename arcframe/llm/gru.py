"""A gated recurrent network over token ids, with an output softmax factored by classes.

Tokens are numbered so that those of a class are neighbours. A token's probability is that of
its class times its own within the class, so a step costs the classes and one class, not the
vocabulary. Biases begin at the logarithms of the token counts and output weights at 0:
the untrained network is the smoothed unigram model.

Training is truncated backpropagation: states run on from window to window, gradients end at
a window's begin. A state begins at 0 behind END, which is also what a text's first step reads.
"""

from __future__ import annotations

import numpy as np

END = 0
WIDTH, HIDDEN = 16, 16
LEAST_LANES, LANES, STEPS = 32, 512, 16
RATE = 0.08
#: Windows, and so changes of the weights, that a stream gets before its lanes are more.
LEAST_WINDOWS = 192
#: Logarithms of odds are held within these: floats behind them, and their squares, are slow subnormals or overflow.
LEAST, MOST = np.float32(-25), np.float32(40)


def _exp(x: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(x, LEAST, MOST, out=x), out=x)


Weights = dict[str, np.ndarray]
NAMES = ("embed", "inputs", "gates", "recurrent", "to_class", "to_token")


def class_bounds(counts: np.ndarray, classes: int) -> np.ndarray:
    """Bounds of neighbouring tokens with about equal sums of the counts' square roots; token 0 is alone, 1 too."""
    tokens = len(counts)
    weight = np.cumsum(np.sqrt(counts[2:] + 0.5))
    cuts = 2 + np.searchsorted(weight, np.arange(1, classes) * (weight[-1] / classes)) if tokens > 2 else []
    return np.unique([0, min(1, tokens), min(2, tokens), *cuts, tokens])


def fresh(counts: np.ndarray, bounds: np.ndarray, seed: int = 7) -> Weights:
    """The untrained weights: probabilities in proportion to counts."""
    rng, tokens, classes = np.random.default_rng(seed), len(counts), len(bounds) - 1
    mass = np.add.reduceat(counts, bounds[:-1])
    biased = lambda bias: np.concatenate([np.zeros((len(bias), HIDDEN)), bias[:, None]], axis=1).astype(np.float32)
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    return {
        "embed": normal(0.3, tokens, WIDTH),
        "inputs": normal(WIDTH**-0.5, 3 * HIDDEN, WIDTH),
        "gates": np.zeros((3 * HIDDEN, 1), np.float32),
        "recurrent": normal(HIDDEN**-0.5, 3 * HIDDEN, HIDDEN),
        "to_class": biased(np.log(mass / mass.sum())),
        "to_token": biased(np.log(counts / np.repeat(mass, np.diff(bounds)))),
    }


class Network:
    """Arrays have the lanes or tokens last, so that each gate and class is one stretch of memory."""

    def __init__(self, weights: Weights, bounds: np.ndarray):
        self.w, self.bounds = weights, bounds
        self.kind = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.alone = np.diff(bounds) == 1

    def states(self, read: np.ndarray, keep: np.ndarray | None, h: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States (steps, HIDDEN, lanes) for ids read (steps, lanes); keep is 0 where a text begins."""
        w, n = self.w, HIDDEN
        fed = np.matmul(w["inputs"], w["embed"][read].transpose(0, 2, 1))
        fed += w["gates"]
        fed[:, : 2 * n] *= np.float32(0.5)
        out = np.empty((len(read), n, read.shape[1]), np.float32)
        for t, x in enumerate(fed):
            if keep is not None:
                h = h * keep[t]
            a = w["recurrent"] @ h
            rz = a[: 2 * n]
            rz *= np.float32(0.5)
            rz += x[: 2 * n]
            np.tanh(rz, out=rz)
            rz *= np.float32(0.5)
            rz += np.float32(0.5)
            c = rz[:n] * a[2 * n :]
            c += x[2 * n :]
            np.tanh(c, out=c)
            if trace is not None:
                trace.append((h, rz[:n], rz[n:], c, a[2 * n :]))
            h = np.subtract(h, c, out=out[t])
            h *= rz[n:]
            h += c
        return out

    def by_class(self, kinds: np.ndarray):
        """(class, rows) of the classes that occur and hold more than one token."""
        order = np.argsort(kinds.astype(np.int16), kind="stable")
        at = np.searchsorted(kinds[order], np.arange(len(self.bounds)))
        for k in np.flatnonzero((np.diff(at) > 0) & ~self.alone):
            yield k, order[at[k] : at[k + 1]]

    def log_probs(self, states: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of the wanted tokens; states (tokens, HIDDEN + 1), the last being 1."""
        w, kinds = self.w, self.kind[wanted]
        logits = w["to_class"] @ states.T
        np.clip(logits, LEAST, MOST, out=logits)
        out = logits[kinds, np.arange(len(wanted))].astype(np.float64)
        out -= np.log(np.exp(logits, out=logits).sum(axis=0))
        for k, rows in self.by_class(kinds):
            lo, hi = self.bounds[k], self.bounds[k + 1]
            own = w["to_token"][lo:hi] @ states[rows].T
            np.clip(own, LEAST, MOST, out=own)
            out[rows] += own[wanted[rows] - lo, np.arange(len(rows))]
            out[rows] -= np.log(np.exp(own, out=own).sum(axis=0))
        return out

    def scores(self, texts: list[np.ndarray], steps: int = 32) -> np.ndarray:
        """Natural log-likelihood of each whole text, END included: its state is carried from window to window."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = np.concatenate([texts[i] for i in order]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        out, h, before = np.zeros(len(texts)), np.zeros((HIDDEN, len(texts)), np.float32), np.full((1, len(texts)), END)
        for at in range(0, int(sizes.max(initial=0)), steps):
            live = int(np.searchsorted(-sizes, -at))
            place = at + np.arange(min(steps, int(sizes[0]) - at))[:, None]
            given = place < sizes[:live]
            wanted = flat[np.where(given, starts[:live] + place, 0)]
            states = self.states(np.concatenate([before[:, :live], wanted[:-1]]), None, np.ascontiguousarray(h[:, :live]))
            h, before = states[-1], wanted[-1:]
            found = self.log_probs(biased_rows(states, given), wanted[given])
            out[:live] += np.bincount(np.nonzero(given)[1], found, live)
        back = np.empty(len(texts))
        back[order] = out
        return back

    def train(self, stream: np.ndarray, seen: Weights) -> None:
        """One pass over a stream of texts, each with its END, cut into lanes. seen: sums of squared gradients, kept."""
        lanes = int(np.clip(len(stream) // (LEAST_WINDOWS * STEPS), LEAST_LANES, LANES))
        length = -(-len(stream) // lanes)
        padded = np.full(lanes * length, -1)
        padded[: len(stream)] = stream
        wanted = np.ascontiguousarray(padded.reshape(lanes, length).T)
        read = np.concatenate([np.full((1, lanes), END), np.maximum(wanted[:-1], END)])
        h = np.zeros((HIDDEN, lanes), np.float32)
        for at in range(0, length, STEPS):
            h = self._window(read[at : at + STEPS], wanted[at : at + STEPS], h, seen)

    def _window(self, read: np.ndarray, wanted: np.ndarray, h: np.ndarray, seen: Weights) -> np.ndarray:
        w, n, trace = self.w, HIDDEN, []
        keep = (read != END).astype(np.float32)
        states = self.states(read, keep, h, trace)
        last, given = states[-1], wanted >= 0
        flat, target = biased_rows(states, given), wanted[given]
        if not len(target):
            return last
        scale, kinds = np.float32(1 / len(target)), self.kind[target]

        odds = _exp(w["to_class"] @ flat.T)
        odds *= scale / odds.sum(axis=0)
        odds[kinds, np.arange(len(target))] -= scale
        back = odds.T @ w["to_class"][:, :n]
        steps = [("to_class", slice(None), odds @ flat)]
        for k, rows in self.by_class(kinds):
            lo, hi = self.bounds[k], self.bounds[k + 1]
            own, to = flat[rows], w["to_token"][lo:hi]
            odds = _exp(to @ own.T)
            odds *= scale / odds.sum(axis=0)
            odds[target[rows] - lo, np.arange(len(rows))] -= scale
            back[rows] += odds.T @ to[:, :n]
            steps.append(("to_token", slice(lo, hi), odds @ own))

        grad = np.zeros((*read.shape, n), np.float32)
        grad[given] = back
        grad = np.ascontiguousarray(grad.transpose(0, 2, 1))
        fed = np.empty((len(read), 3 * n, read.shape[1]), np.float32)
        to_recurrent = np.zeros((3 * n, n), np.float32)
        dh = np.zeros_like(last)
        for t in range(len(read) - 1, -1, -1):
            dh += grad[t]
            before, r, z, c, a = trace[t]
            own = fed[t]
            dc = (1 - z) * dh
            dc *= 1 - c * c
            own[2 * n :] = dc
            np.multiply(dh, before - c, out=own[n : 2 * n])
            own[n : 2 * n] *= z * (1 - z)
            np.multiply(dc, a, out=own[:n])
            own[:n] *= r * (1 - r)
            hidden = own.copy()
            hidden[2 * n :] *= r
            to_recurrent += hidden @ before.T
            dh *= z
            dh += w["recurrent"].T @ hidden
            dh *= keep[t]
        rows = fed.transpose(0, 2, 1).reshape(-1, 3 * n)
        ids = read.ravel()
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        distinct, first = np.unique(ids[order], return_index=True)
        steps += [
            ("recurrent", slice(None), to_recurrent),
            ("inputs", slice(None), rows.T @ w["embed"][ids]),
            ("gates", slice(None), rows.sum(axis=0)[:, None]),
            ("embed", distinct, np.add.reduceat((rows @ w["inputs"])[order], first, axis=0)),
        ]
        for name, where, g in steps:
            sums = seen[name][where] + g * g
            seen[name][where] = sums
            w[name][where] -= RATE * g / np.sqrt(sums + np.float32(1e-8))
        return last


def biased_rows(states: np.ndarray, given: np.ndarray) -> np.ndarray:
    """(tokens, HIDDEN + 1): the states of given (step, lane) places, with a last column of ones."""
    out = np.ones((int(given.sum()), states.shape[1] + 1), np.float32)
    out[:, :-1] = states.transpose(0, 2, 1)[given]
    return out


def packed(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in NAMES])


def unpacked(flat: np.ndarray, like: Weights) -> Weights:
    sizes = np.cumsum([like[k].size for k in NAMES])[:-1]
    return {k: x.reshape(like[k].shape).copy() for k, x in zip(NAMES, np.split(flat, sizes))}
