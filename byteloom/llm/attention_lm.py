"""A causal self-attention model over subword ids, in numpy.

One layer, one head, a residual stream of D floats. The next id's probability is that of its class,
which the network gives from the context, times the id's share of its class. Half of the classes hold ids that
begin a word, half those that go on with one. An id that begins a word has the share that it has in the
training documents; one that goes on has its share after the id before it, counted over the words of all
training documents and smoothed by its share anywhere. Shares in a class add up to 1.
Windows of T inputs overlap by KEEP: a window's first KEEP positions are context only, so every token is
scored once, with at least KEEP earlier tokens in view wherever the text has them. Training and scoring
have the same formula; as only positions from KEEP on are scored, only theirs are computed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

T, KEEP, D, HIDDEN, CLASSES, INPUTS = 32, 8, 24, 48, 64, 4096
STEP = T - KEEP
NEG = np.float32(-1e9)
#: What a pair's share is smoothed with, in counts.
SMOOTH = 2.0
#: Width of a projected context; windows that training goes over at least, by more passes over a small corpus.
CONTEXT, LEAST = 24, 72_000
#: Row sums as matrix products.
ONES = np.ones(CLASSES, np.float32)
CAUSAL = np.triu(np.full((T, T), NEG, np.float32), 1)


@dataclass
class Vocabulary:
    """inputs: id -> row of the embedding; classes: id -> class; logp: id -> log10 of its share in the class; end: the id that ends a text."""

    inputs: np.ndarray
    classes: np.ndarray
    logp: np.ndarray
    end: int


def input_rows(counts: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """The commonest ids have rows of their own, the others share the last quarter by their number; those that begin a word share its first half."""
    own = INPUTS - INPUTS // 4
    half = (INPUTS - own) // 2
    order = np.lexsort((np.arange(len(counts)), -counts))
    rows = own + np.arange(len(counts)) % half + np.where(np.ones(len(counts), bool) if starts is None else starts, 0, half)
    rows[order[:own]] = np.arange(min(own, len(counts)))
    return rows.astype(np.int32)


def group(vocab: Vocabulary, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The number of each id's class after the id before it."""
    return before * CLASSES + vocab.classes[ids]


class Pairs:
    """Shares of ids that go on with a word, after the id before them. pairs: pair (before * ids + id) -> times; groups -> totals: the times of all pairs of a group, by default of those given."""

    def __init__(self, vocab: Vocabulary, pairs: np.ndarray, times: np.ndarray, groups: np.ndarray | None = None, totals: np.ndarray | None = None) -> None:
        self.vocab, self.n = vocab, len(vocab.classes)
        self.anywhere = 10.0**vocab.logp
        order = np.argsort(pairs)
        self.pairs, self.times = pairs[order], times[order].astype(np.float64)
        if groups is None:
            self.groups, where = np.unique(group(vocab, self.pairs // self.n, self.pairs % self.n), return_inverse=True)
            self.totals = np.bincount(where, weights=self.times, minlength=len(self.groups))
        else:
            order = np.argsort(groups)
            self.groups, self.totals = groups[order], totals[order].astype(np.float64)

    @staticmethod
    def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted))
        # Sorted and without repeats, the search walks the keys in order.
        wanted, back = np.unique(wanted, return_inverse=True)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0.0)[back]

    def shares(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log10 of each id's share of its class after the id before it; a pair that was not given counts as seen 0 times."""
        times = self._found(self.pairs, self.times, before * self.n + ids)
        total = self._found(self.groups, self.totals, group(self.vocab, before, ids))
        return np.log10((times + SMOOTH * self.anywhere[ids]) / (total + SMOOTH))

    def holds(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which pairs were given."""
        return self._found(self.pairs, np.ones(len(self.pairs)), before * self.n + ids) > 0


def sums_of_rows(number: int, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each of so many rows, the sum of the values that rows gives to it."""
    out = np.zeros((number, values.shape[1]), values.dtype)
    if len(rows):
        order = np.argsort(rows.astype(np.uint16), kind="stable")
        ordered = rows[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        out[ordered[first]] = np.add.reduceat(values.take(order, axis=0), first, axis=0)
    return out


class Neighbours:
    """How often each embedding row stands right before each other one."""

    def __init__(self) -> None:
        self.times, self.most = np.zeros(INPUTS * INPUTS, np.uint32), 0

    def see(self, rows: np.ndarray) -> None:
        for k in range(0, len(rows) - 1, 1 << 18):
            a, b = rows[k : k + (1 << 18)], rows[k + 1 : k + 1 + (1 << 18)]
            np.add.at(self.times, a[: len(b)].astype(np.int64) * INPUTS + b, np.uint32(1))
        self.most += len(rows)

    @property
    def full(self) -> bool:
        """Whether the counts may soon be too large for their type."""
        return self.most > 1 << 31

    def contexts(self, seen: np.ndarray, seed: int = 5) -> np.ndarray:
        """Sums of the projected neighbours after and before each embedding row; those of parts of a corpus add up. seen: how often each row stands in all of it."""
        project = np.random.default_rng(seed).standard_normal((INPUTS, CONTEXT)).astype(np.float32)
        project *= (1 / np.sqrt(seen + 1)).astype(np.float32)[:, None]
        project = project.astype(np.float64)
        out = np.zeros((INPUTS, 2 * CONTEXT))
        for k in range(0, INPUTS, 256):
            times = self.times[k * INPUTS : (k + 256) * INPUTS].reshape(-1, INPUTS).astype(np.float64)
            out[k : k + 256, :CONTEXT] = times @ project
            out[:, CONTEXT:] += times.T @ project[k : k + 256]
        return out


def contexts(rows: np.ndarray, seen: np.ndarray, seed: int = 5) -> np.ndarray:
    """Neighbours.contexts() of rows in a row."""
    near = Neighbours()
    near.see(rows)
    return near.contexts(seen, seed)


def cluster(sums: np.ndarray, seen: np.ndarray, number: int = CLASSES) -> np.ndarray:
    """Classes of embedding rows from the sums of their contexts, by k-means."""
    x = (sums / (seen[:, None] + 3)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-6
    order = np.argsort(-seen, kind="stable")
    centres = x[order[:number]].copy()
    got = np.zeros(len(x), np.int64)
    mass = np.sqrt(seen + 0.1)
    for _ in range(15):
        got = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            own = got == c
            if own.any():
                mean = (x[own] * mass[own][:, None]).sum(axis=0)
                centres[c] = mean / (np.linalg.norm(mean) + 1e-6)
    return got.astype(np.int32)


def vocabulary(counts: np.ndarray, end: int, ids: np.ndarray, starts: np.ndarray | None = None) -> Vocabulary:
    """counts: how often each id stands in the training documents; ids: those documents' ids in a row; starts: which ids begin a word."""
    rows = input_rows(counts, starts)[ids]
    seen = np.bincount(rows, minlength=INPUTS)
    return vocabulary_of(counts, end, contexts(rows, seen), seen, starts)


def vocabulary_of(counts: np.ndarray, end: int, sums: np.ndarray, seen: np.ndarray, starts: np.ndarray | None = None) -> Vocabulary:
    """As vocabulary(), from the sums of contexts."""
    inputs = input_rows(counts, starts)
    begin = np.ones(len(counts), bool) if starts is None else starts
    row_begins = np.zeros(INPUTS, bool)
    row_begins[inputs[begin]] = True
    of_row = np.zeros(INPUTS, np.int32)
    number = CLASSES if begin.all() else CLASSES // 2
    for first, group in ((0, row_begins), (number, ~row_begins)):
        if first < CLASSES:
            of_row[group] = first + (cluster(sums[group], seen[group], number) if seen.any() else np.arange(int(group.sum()), dtype=np.int32) % number)
    classes = of_row[inputs]
    total = np.bincount(classes, weights=counts + 1.0, minlength=CLASSES)
    return Vocabulary(inputs, classes, np.log10((counts + 1.0) / total[classes]), end)


def initial(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    make = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    return {
        "E": make(INPUTS, D, s=0.1), "P": make(T, D, s=0.05), "Wq": make(D, D, s=0.2), "Wk": make(D, D, s=0.2), "Wv": make(D, D, s=0.2), "Wo": make(D, D, s=0.1),
        "W1": make(D, HIDDEN, s=0.2), "b1": np.zeros(HIDDEN, np.float32), "W2": make(HIDDEN, D, s=0.1), "b2": np.zeros(D, np.float32), "U": make(D, CLASSES, s=0.2), "c": np.zeros(CLASSES, np.float32),
    }


def projected(p: dict) -> dict:
    """p with every embedding row's and position's query, key and value (already through Wo) beside it, so that scoring looks them up; c then holds b2 too."""
    scale = p["Wq"].dtype.type(D**-0.5)
    w = np.concatenate([p["Wq"] * scale, p["Wk"], p["Wv"] @ p["Wo"]], axis=1)
    return p | {"c": p["b2"] @ p["U"] + p["c"], "rows": np.concatenate([p["E"] @ w, p["E"]], axis=1), "places": np.concatenate([p["P"] @ w, p["P"]], axis=1)}


def exponents(z: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """exp of the rows of z, each less some number that is taken from z too, and the sums of exp. The largest of all is that number, which is
    quickly found; each row's own where a row is so far below it that its sum could lose digits. skip: rows that don't matter."""
    z -= z.max()
    e = np.exp(z)
    total = e @ ONES[: z.shape[1]].astype(z.dtype)
    low = total < 1e-20
    if low.any():
        if skip is not None and not (low & ~skip).any():
            total[low] = 1
        else:
            z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=e)
            total = e @ ONES[: z.shape[1]].astype(z.dtype)
    return e, total


def hidden(p: dict, x: np.ndarray, absent: np.ndarray | None) -> tuple:
    """The block for windows x of embedding rows; absent: positions outside the text. The residual stream at the positions from KEEP on, then what its gradients need."""
    n, h0 = len(x), None
    if "rows" in p:
        all_ = p["rows"].take(x, axis=0)
        all_ += p["places"]
        q, k, v = all_[:, KEEP:, :D], all_[:, :, D : 2 * D], all_[:, :, 2 * D : 3 * D]
        late = all_[:, KEEP:, 3 * D :].reshape(-1, D)
    else:
        h0 = p["E"].take(x, axis=0)
        h0 += p["P"]
        late = np.ascontiguousarray(h0[:, KEEP:]).reshape(-1, D)
        k, v = ((h0.reshape(-1, D) @ p[w]).reshape(n, T, D) for w in ("Wk", "Wv"))
        q = (late @ (p["Wq"] * p["Wq"].dtype.type(D**-0.5))).reshape(n, STEP, D)
    a = q @ k.transpose(0, 2, 1)
    a += CAUSAL[KEEP:]
    if absent is not None:
        partly = absent.any(axis=1)
        a[partly] += np.where(absent[partly], NEG, np.float32(0))[:, None, :]
    a, total = exponents(a.reshape(-1, T), None if absent is None else absent[:, KEEP:].ravel())
    a /= total[:, None]
    a = a.reshape(n, STEP, T)
    o = (a @ v).reshape(-1, D)
    h1 = o if h0 is None else o @ p["Wo"]
    h1 += late
    m = h1 @ p["W1"]
    m += p["b1"]
    np.maximum(m, 0, out=m)
    h2 = m @ p["W2"]
    h2 += h1
    if h0 is not None:
        h2 += p["b2"]
    return h2, h0, late, q, k, v, a, o, h1, m


def gradients(p: dict, x: np.ndarray, absent: np.ndarray, y: np.ndarray, scored: np.ndarray) -> tuple[float, dict]:
    """Mean loss over the scored positions, and its gradients. No position before KEEP is scored."""
    h2, h0, late, q, k, v, a, o, h1, m = hidden(p, x, absent)
    n, count, scale = len(x), max(1, int(scored.sum())), p["Wq"].dtype.type(D**-0.5)
    use = scored[:, KEEP:].ravel()
    z = h2 @ p["U"]
    z += p["c"]
    dz, total = exponents(z)
    own = np.arange(len(z)) * CLASSES + y[:, KEEP:].ravel()
    loss = -float((z.ravel()[own] - np.log(total))[use].sum()) / count
    weight = (use / count).astype(dz.dtype)
    dz *= (weight / total)[:, None]
    dz.ravel()[own] -= weight
    ones = np.ones(len(dz), dz.dtype)
    g = {"U": h2.T @ dz, "c": ones @ dz}
    dh2 = dz @ p["U"].T
    g["W2"], g["b2"] = m.T @ dh2, ones @ dh2
    dm = dh2 @ p["W2"].T
    dm *= m > 0
    g["W1"], g["b1"] = h1.T @ dm, ones @ dm
    dh1 = dm @ p["W1"].T
    dh1 += dh2
    g["Wo"] = o.T @ dh1
    do = (dh1 @ p["Wo"].T).reshape(n, STEP, D)
    dv = (a.transpose(0, 2, 1) @ do).reshape(-1, D)
    ds = do @ v.transpose(0, 2, 1)
    ds *= a
    ds -= a * (ds.reshape(-1, T) @ ONES[:T].astype(ds.dtype)).reshape(n, STEP, 1)
    # q holds the scale already; the gradient of Wq gets it once more.
    dq, dk = (ds @ k).reshape(-1, D), (ds.transpose(0, 2, 1) @ q).reshape(-1, D)
    h = h0.reshape(-1, D)
    g["Wq"], g["Wk"], g["Wv"] = late.T @ dq * scale, h.T @ dk, h.T @ dv
    dh0 = dk @ p["Wk"].T
    dh0 += dv @ p["Wv"].T
    dh0 = dh0.reshape(n, T, D)
    dh1 += dq @ (p["Wq"].T * scale)
    dh0[:, KEEP:] += dh1.reshape(n, STEP, D)
    g["P"] = dh0.sum(axis=0)
    g["E"] = sums_of_rows(len(p["E"]), x.ravel(), dh0.reshape(-1, D))
    return loss, g


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many targets in a row (inputs lie likewise): index of each window's inputs, whether they are absent, and each window's text."""
    per = -(-lengths // STEP)
    text = np.repeat(np.arange(len(lengths)), per)
    first = np.repeat(np.cumsum(lengths) - lengths, per)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    at = (number * STEP - KEEP)[:, None] + np.arange(T)
    absent = (at < 0) | (at >= lengths[text][:, None])
    return np.where(absent, 0, at + first[:, None]), absent, text


class Adam:
    """Adam on the parameters p, which become views of one vector."""

    def __init__(self, p: dict) -> None:
        self.p, self.t, self.all = p, 0, packed(p).astype(np.float32)
        p |= {k: self.all[i : i + p[k].size].reshape(p[k].shape) for k, i in PLACES.items()}
        #: Ten times the mean of gradients, a hundred times that of their squares.
        self.m, self.s, self.g, self.d = (np.zeros_like(self.all) for _ in range(4))

    def step(self, g: dict, rate: float) -> None:
        self.t += 1
        up, spread = np.float32(0.1 * rate / (1 - 0.9**self.t)), np.float32(0.1 * (1 - 0.99**self.t) ** -0.5)
        np.concatenate([g[k].ravel() for k in NAMES], out=self.g, casting="same_kind")
        if self.t % 64 == 0:  # arithmetic on the tiniest numbers is slow
            for x in (self.m, self.s):
                x[np.abs(x) < 1e-30] = 0
        # Parts that stay in the cache.
        for k in range(0, len(self.all), 1 << 14):
            m, s, g, d, p = (x[k : k + (1 << 14)] for x in (self.m, self.s, self.g, self.d, self.all))
            m *= np.float32(0.9)
            m += g
            s *= np.float32(0.99)
            g *= g
            s += g
            np.sqrt(s, out=d)
            d *= spread
            d += np.float32(1e-8)
            np.divide(m, d, out=d)
            d *= up
            p -= d


def start(share: np.ndarray) -> dict:
    """Parameters before training. share: each class's share of the training documents."""
    return initial() | {"c": np.log(share / share.sum()).astype(np.float32)}


def passes(n_windows: int) -> int:
    """How often training goes over all windows: once, or more in a small corpus."""
    return max(1, -(-LEAST // max(1, n_windows)))


class Learner:
    """Goes over the windows of the texts given to it, each window once a call; used holds how often each embedding row was an input."""

    LATE = np.arange(T) >= KEEP

    def __init__(self, vocab: Vocabulary, p: dict, rate: float, batch: int = 48, warm: int = 50, seed: int = 9) -> None:
        self.vocab, self.rate, self.batch, self.warm = vocab, rate, batch, warm
        self.adam = Adam({k: v.copy() for k, v in p.items()})
        self.rng = np.random.default_rng(seed)
        self.windows, self.used = 0, np.zeros(INPUTS)

    def see(self, texts: list[np.ndarray]) -> None:
        inputs, targets, lengths = joined(self.vocab, texts)
        x, y = self.vocab.inputs[inputs], self.vocab.classes[targets]
        at, absent, _ = windows(lengths)
        self.windows += len(at)
        self.used += np.bincount(x, minlength=INPUTS)
        for w in np.array_split(self.rng.permutation(len(at)), -(-len(at) // self.batch)):
            i, gone = at[w], absent[w]
            _, g = gradients(self.adam.p, x[i], gone, y[i], self.LATE & ~gone)
            self.adam.step(g, self.rate * min(1.0, (self.adam.t + 1) / self.warm))


#: The parameters as one vector, the embedding last.
NAMES = (*sorted(k for k in initial() if k != "E"), "E")
_SIZES = [initial()[k].size for k in NAMES]
#: Where each begins.
PLACES = dict(zip(NAMES, (np.cumsum(_SIZES) - _SIZES).tolist(), strict=True))


def packed(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in NAMES])


def unpacked(flat: np.ndarray) -> dict:
    out, at = {}, 0
    like = initial()
    for k in NAMES:
        v = like[k]
        out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


def weighed(learner: Learner) -> np.ndarray:
    """What a learner adds to the mean: its parameters times its windows, embedding rows times their uses, then windows and uses."""
    p = learner.adam.p
    flat = packed(p | {"E": np.zeros_like(p["E"])}).astype(np.float64) * learner.windows
    flat[-p["E"].size :] = (p["E"] * learner.used[:, None]).ravel()
    return np.concatenate([flat, [learner.windows], learner.used])


def mean(total: np.ndarray, old: dict) -> dict:
    """The parameters from the sum of what the learners added; a row that none of them used stays as it was."""
    flat, n, used = total[: -INPUTS - 1], total[-INPUTS - 1], total[-INPUTS:]
    if not n:
        return old
    p = unpacked(flat / n)
    sums = flat[-old["E"].size :].reshape(INPUTS, D)
    return p | {"E": np.where(used[:, None] > 0, sums / np.maximum(used, 1)[:, None], old["E"]).astype(np.float32)}


def train(vocab: Vocabulary, texts: list[np.ndarray], steps: int = 1500, batch: int = 48, rate: float = 4e-3, seed: int = 9) -> dict:
    """Adam over drawn windows of texts that fit the driver, each given as ids without the end."""
    if not texts:
        return initial()
    inputs, targets, lengths = joined(vocab, texts)
    x = vocab.inputs[inputs]
    y = vocab.classes[targets]
    at, absent, _ = windows(lengths)
    p = start(np.bincount(y, minlength=CLASSES) + 1.0)
    adam = Adam(p)
    rng = np.random.default_rng(seed)
    for t in range(1, steps + 1):
        w = rng.integers(0, len(at), batch)
        _, g = gradients(p, x[at[w]], absent[w], y[at[w]], Learner.LATE & ~absent[w])
        adam.step(g, rate * min(1.0, t / 50) * (1 - 0.9 * t / steps))
    return p


def joined(vocab: Vocabulary, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (the end, then the ids), targets (the ids, then the end) of all texts in a row, and their lengths."""
    lengths = np.array([len(x) + 1 for x in texts], np.int64)
    end = np.array([vocab.end], np.int64)
    targets = np.concatenate([z for x in texts for z in (x, end)]).astype(np.int64)
    inputs = np.concatenate([z for x in texts for z in (end, x)]).astype(np.int64)
    return inputs, targets, lengths


def score(p: dict, vocab: Vocabulary, texts: list[np.ndarray], shares: np.ndarray | None = None, chunk: int = 64) -> np.ndarray:
    """log10 probability of each text. shares: the sums of the shares of its ids and its end; without them those that logp has."""
    if not texts:
        return np.zeros(0)
    p = p if "rows" in p else projected(p)
    inputs, targets, lengths = joined(vocab, texts)
    x, y = vocab.inputs[inputs], vocab.classes[targets]
    out = np.add.reduceat(vocab.logp[targets], np.cumsum(lengths) - lengths) if shares is None else shares
    at, absent, text = windows(lengths)
    partly = absent.any(axis=1)
    gains = np.zeros(len(at))
    for k in range(0, len(at), chunk):
        i, gone = at[k : k + chunk], absent[k : k + chunk]
        z = hidden(p, x[i], gone if partly[k : k + chunk].any() else None)[0] @ p["U"]
        z += p["c"]
        total = exponents(z)[1]
        lp = z.ravel()[np.arange(len(z)) * CLASSES + y[i[:, KEEP:]].ravel()]
        lp -= np.log(total)
        lp = lp.reshape(-1, STEP)
        lp[gone[:, KEEP:]] = 0
        gains[k : k + chunk] = lp.sum(axis=1, dtype=np.float64)
    return out + np.bincount(text, weights=gains, minlength=len(texts)) / np.log(10)


def in_groups(texts: list[np.ndarray], most: int = 1 << 18) -> Iterator[list[np.ndarray]]:
    """Texts in groups of a bounded number of ids (a longer text alone)."""
    group, n = [], 0
    for x in texts:
        if group and n + len(x) > most:
            yield group
            group, n = [], 0
        group.append(x)
        n += len(x)
    if group:
        yield group
