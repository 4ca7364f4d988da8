"""A small bidirectional gated recurrent network with attention pooling over windows of words, in numpy."""

from __future__ import annotations

import numpy as np

from welfarelens.llm.kept import at_work

#: Words of a window and words from one window's start to the next.
WINDOW, STRIDE = 32, 24
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
#: Byte n-grams of these sizes, hashed into so many buckets.
GRAMS, BUCKET_BITS = (3, 4, 5), 15
#: Windows computed at once, and words whose projections a worker keeps.
BLOCK, KEPT_WORDS = 2048, 120_000

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def letter_words(text: str | None) -> list[bytes]:
    """Runs of letters in UTF-8, A-Z in lower case."""
    return (text or "").encode("utf-8", "replace").translate(_LETTERS).split()


def char_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of each word with its ends marked, word by word, and where each word's begin."""
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint32)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    keys, owners, rolling = [], [], np.zeros(len(flat), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        rolling = rolling[: len(flat) - n + 1] * np.uint32(0x01000193) ^ (flat[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
        if n in GRAMS:
            own = word[: len(rolling)] == word[n - 1 :]
            mixed = rolling[own]
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            keys.append(mixed >> np.uint32(32 - BUCKET_BITS))
            owners.append(word[: len(rolling)][own])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(words))
    return np.concatenate(keys)[order].astype(np.int64), np.cumsum(counts) - counts


def window_starts(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, first word) of all overlapping windows of documents that stand one after another.

    The last window of a document ends at its last word; a document of fewer words than a window has one window.
    """
    counts = np.where(lengths <= WINDOW, 1, -(-(lengths - WINDOW) // STRIDE) + 1)
    document = np.repeat(np.arange(len(lengths)), counts)
    number = np.arange(len(document)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.cumsum(lengths) - lengths
    return document, first[document] + np.minimum(number * STRIDE, np.maximum(lengths - WINDOW, 0)[document])


def window_words(flat: np.ndarray, lengths: np.ndarray, document: np.ndarray, starts: np.ndarray, pad: int) -> np.ndarray:
    at = starts[:, None] + np.arange(WINDOW)
    outside = at >= np.cumsum(lengths)[document][:, None]
    padded = np.append(flat, pad)
    return padded[np.where(outside, len(flat), at)]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters by name. Words outside the vocabulary share row 0 of ``word`` and differ by their characters."""

    def __init__(self, vocabulary: dict[bytes, int], seed: int = 0):
        rng = np.random.default_rng(seed)
        scale = lambda *shape: (rng.standard_normal(shape) * (0.4 / np.sqrt(shape[0]) if len(shape) > 1 and shape[0] < 100 else 0.1)).astype(np.float32)
        self.vocabulary = vocabulary
        inputs, both = WORD_DIM + CHAR_DIM, 2 * HIDDEN
        self.p = {"word": scale(len(vocabulary) + 1, WORD_DIM), "char": scale(1 << BUCKET_BITS, CHAR_DIM)}
        for d in "fb":
            self.p |= {"W" + d: scale(inputs, 3 * HIDDEN), "U" + d: scale(HIDDEN, 3 * HIDDEN), "c" + d: np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": scale(both, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": scale(ATTENTION, 1)[:, 0], "w": scale(both, 1)[:, 0], "b": np.zeros(1, np.float32)}
        self.slope, self.shift = 1.0, 0.0
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((0, 6 * HIDDEN), np.float32)

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "table": np.zeros((0, 6 * HIDDEN), np.float32)}

    def features(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        get = self.vocabulary.get
        return (np.fromiter((get(w, 0) for w in words), np.int64, len(words)), *char_grams(words))

    def inputs(self, ids, grams, firsts) -> np.ndarray:
        """Input vectors of words: word embedding beside the mean of the n-grams' embeddings."""
        counts = np.diff(np.append(firsts, len(grams)))
        chars = np.add.reduceat(self.p["char"][grams], firsts, axis=0) / counts[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][ids], chars], axis=1)

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p["W" + d] + self.p["c" + d] for d in "fb"}

    def _direction(self, d: str, projected, ids, mask, keep):
        h = np.zeros((len(ids), HIDDEN), np.float32)
        U, out, cache = self.p["U" + d], [None] * WINDOW, []
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            x, m = projected[ids[:, t]], mask[:, t : t + 1]
            u = h @ U
            zr = sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            new = h + m * (1 - z) * (n - h)
            if keep:
                cache.append((t, h, z, r, n, u[:, 2 * HIDDEN :]))
            h = out[t] = new
        return out, cache

    def forward(self, projected, ids, pad: int, keep: bool = False):
        """Logits of windows ``ids`` (rows of ``projected``; ``pad`` is no word)."""
        mask = (ids != pad).astype(np.float32)
        fw, cf = self._direction("f", projected["f"], ids, mask, keep)
        bw, cb = self._direction("b", projected["b"], ids, mask, keep)
        H = np.concatenate([np.stack(fw, 1), np.stack(bw, 1)], axis=2)
        T = np.tanh(H @ self.p["A"] + self.p["a"])
        e = np.where(mask > 0, T @ self.p["v"], -1e9)
        e = np.exp(e - e.max(axis=1, keepdims=True)) * mask
        alpha = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-9)
        pooled = (alpha[:, :, None] * H).sum(axis=1)
        logits = pooled @ self.p["w"] + self.p["b"][0]
        return logits, (mask, cf, cb, H, T, alpha, pooled) if keep else None

    def backward(self, dlogits, ids, state, rows: int):
        """Gradients of the parameters above the inputs, and of the projected inputs by direction."""
        mask, cf, cb, H, T, alpha, pooled = state
        p, g = self.p, {"b": np.array([dlogits.sum()], np.float32), "w": pooled.T @ dlogits}
        dpooled = dlogits[:, None] * p["w"]
        dH = alpha[:, :, None] * dpooled[:, None, :]
        dalpha = np.einsum("btk,bk->bt", H, dpooled)
        de = alpha * (dalpha - (alpha * dalpha).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("bt,btk->k", de, T)
        dT = de[:, :, None] * p["v"] * (1 - T * T)
        g["A"], g["a"] = np.einsum("bti,btk->ik", H, dT), dT.sum(axis=(0, 1))
        dH += dT @ p["A"].T
        dprojected = {}
        for d, cache, part in (("f", cf, dH[:, :, :HIDDEN]), ("b", cb, dH[:, :, HIDDEN:])):
            U, dU, dh = p["U" + d], np.zeros_like(p["U" + d]), np.zeros((len(ids), HIDDEN), np.float32)
            dxs, at = [], []
            for t, h, z, r, n, un in reversed(cache):
                dh = dh + part[:, t]
                m = mask[:, t : t + 1]
                dz = -dh * m * (n - h) * z * (1 - z)
                dn = dh * m * (1 - z) * (1 - n * n)
                dr = dn * un * r * (1 - r)
                dx = np.concatenate([dz, dr, dn], axis=1)
                du = np.concatenate([dz, dr, dn * r], axis=1)
                dxs.append(dx)
                at.append(ids[:, t])
                dU += h.T @ du
                dh = dh * (1 - m * (1 - z)) + du @ U.T
            g["U" + d], dprojected[d] = dU, summed(np.concatenate(at), np.concatenate(dxs), rows)
        return g, dprojected

    def infer(self, table: np.ndarray, ids: np.ndarray, pad: int) -> np.ndarray:
        """As ``forward``, both directions at once and without traces. ``table`` is made by ``scaled``."""
        n, k = len(ids), HIDDEN
        U = np.zeros((2 * k, 6 * k), np.float32)
        for i, d in enumerate("fb"):
            for gate in range(3):
                U[i * k : (i + 1) * k, (2 * gate + i) * k : (2 * gate + i + 1) * k] = self.p["U" + d][:, gate * k : (gate + 1) * k] * (0.5 if gate < 2 else 1)
        back = np.concatenate([np.arange((2 * g + 1) * k, (2 * g + 2) * k) for g in range(3)])
        across = np.ascontiguousarray(ids.T)
        mask = (across != pad).astype(np.float32)
        H = np.empty((WINDOW, n, 2 * k), np.float32)
        h, both = np.zeros((n, 2 * k), np.float32), np.empty((n, 2 * k), np.float32)
        for t in range(WINDOW):
            x = table[across[t]]
            x[:, back] = table[across[WINDOW - 1 - t]][:, back]
            u = h @ U
            zr = np.tanh(x[:, : 4 * k] + u[:, : 4 * k])
            zr *= 0.5
            zr += 0.5
            x, u = x[:, 4 * k :], u[:, 4 * k :]
            u *= zr[:, 2 * k :]
            u += x
            np.tanh(u, out=u)
            u -= h
            u *= 1 - zr[:, : 2 * k]
            both[:, :k], both[:, k:] = mask[t][:, None], mask[WINDOW - 1 - t][:, None]
            u *= both
            h = h + u
            H[t, :, :k], H[WINDOW - 1 - t, :, k:] = h[:, :k], h[:, k:]
        e = np.tanh(H @ self.p["A"] + self.p["a"]) @ self.p["v"]
        e = np.exp(e - e.max(axis=0)) * mask
        alpha = e / np.maximum(e.sum(axis=0), 1e-9)
        return np.einsum("tb,tbk,k->b", alpha, H, self.p["w"], optimize=True) + self.p["b"][0]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Projections of inputs for ``infer``: update, reset and new-state parts, forward beside backward in each."""
        out, k = self.project(x), HIDDEN
        return np.concatenate([out[d][:, g * k : (g + 1) * k] * (0.5 if g < 2 else 1) for g in range(3) for d in "fb"], axis=1).astype(np.float32)

    def forget(self) -> None:
        self.known, self.table = {}, np.zeros((0, 6 * HIDDEN), np.float32)

    def rows_of(self, words: set[bytes]) -> dict[bytes, int]:
        """Rows of ``table`` for ``words``. Row 0 is no word. Projections are kept for later batches."""
        at_work("toxicity", self.forget)
        if len(self.known) > KEPT_WORDS or not len(self.table):
            self.known, self.table = {}, np.zeros((1, 6 * HIDDEN), np.float32)
        new = [w for w in words if w not in self.known]
        if new:
            made = [self.scaled(self.inputs(*self.features(new[a : a + 20_000]))) for a in range(0, len(new), 20_000)]
            self.known.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, *made])
        return self.known

    def window_logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(document, logit) of all overlapping windows of all texts."""
        split = [letter_words(t) for t in texts]
        rows = self.rows_of(set().union(*split))
        lengths = np.array([len(s) for s in split], np.int64)
        flat = np.fromiter((rows[w] for s in split for w in s), np.int32, int(lengths.sum()))
        document, starts = window_starts(lengths)
        out = np.empty(len(starts), np.float32)
        for at in range(0, len(starts), BLOCK):
            block = slice(at, at + BLOCK)
            out[block] = self.infer(self.table, window_words(flat, lengths, document[block], starts[block], 0), 0)
        return document, out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each text: that of its most suspicious window, calibrated."""
        if not texts:
            return np.empty(0)
        document, logits = self.window_logits(texts)
        most = np.full(len(texts), -np.inf)
        np.maximum.at(most, document, logits)
        return sigmoid(self.slope * most.astype(float) + self.shift)


def summed(at: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of ``values`` by the row they belong to."""
    order = np.argsort(at, kind="stable")
    at, out = at[order], np.zeros((rows, values.shape[1]), np.float32)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else []
    if len(first):
        out[at[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


class Adam:
    def __init__(self, params, rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.s = {k: np.zeros_like(v) for k, v in params.items()}

    def apply(self, grads):
        self.step += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.s[k] += 0.001 * (g * g - self.s[k])
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.s[k] / (1 - 0.999**self.step)) + 1e-8)


def train(texts: list[str], labels: np.ndarray, epochs: int = 10, batch: int = 192, rate: float = 0.01, least_documents: int = 3, seed: int = 0) -> Network:
    """Fit on labelled documents, of which only some window makes them toxic.

    Each epoch takes the highest windows of a document by the present network: one of a document labelled 1, the highest
    and a random one of the others. At first positive windows are drawn at random. Slope and shift of the final
    probability are fitted on a fifth of the documents that took no part in the training.
    """
    rng = np.random.default_rng(seed)
    split = [letter_words(t) for t in texts]
    held = np.arange(len(texts)) % 5 == 4
    seen: dict[bytes, int] = {}
    for s, h in zip(split, held):
        for w in () if h else set(s):
            seen[w] = seen.get(w, 0) + 1
    vocabulary = {w: i + 1 for i, w in enumerate(sorted(w for w, n in seen.items() if n >= least_documents))}
    net = Network(vocabulary, seed)
    if not len(texts) or len(set(labels.tolist())) < 2:
        net.p["w"][:] = 0
        net.shift = float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 1.0)))  # without labels, not toxic
        return net
    different = {w: i for i, w in enumerate(sorted(set().union(*split)))}
    ids, grams, firsts = net.features(list(different))
    gram_counts = np.diff(np.append(firsts, len(grams)))
    lengths = np.array([len(s) for s in split], np.int64)
    flat = np.fromiter((different[w] for s in split for w in s), np.int32, int(lengths.sum()))
    del split
    document, starts = window_starts(lengths)
    pad = len(different)
    windows = window_words(flat, lengths, document, starts, pad)
    y = labels.astype(np.float32)
    fit = ~held[document]
    adam = Adam(net.p, rate)

    def logits():
        x = np.concatenate([net.inputs(ids, grams, firsts), np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)])
        table = net.scaled(x)
        table[pad] = 0
        return np.concatenate([net.infer(table, windows[a : a + BLOCK], pad) for a in range(0, len(windows), BLOCK)])

    def highest(values):
        order = np.lexsort((-values, document))
        return order[np.append(True, np.diff(document[order]) > 0)]

    for epoch in range(epochs):
        noise = rng.standard_normal(len(windows)) * 10
        drawn = highest(noise)
        chosen = highest(logits()) if epoch >= 2 else drawn
        chosen = np.concatenate([chosen, drawn[y[document[drawn]] == 0] if epoch >= 2 else np.flatnonzero(rng.random(len(windows)) < 0.15)])
        chosen = rng.permutation(chosen[fit[chosen]])
        for a in range(0, len(chosen), batch):
            rows = windows[chosen[a : a + batch]]
            used, local = np.unique(rows, return_inverse=True)
            local = local.reshape(rows.shape)
            words = used[used != pad]
            spans = [np.arange(firsts[w], firsts[w] + gram_counts[w]) for w in words]
            own = grams[np.concatenate(spans)] if spans else np.empty(0, np.int64)
            counts = gram_counts[words]
            x = np.zeros((len(used), WORD_DIM + CHAR_DIM), np.float32)
            if len(words):
                x[: len(words)] = net.inputs(ids[words], own, np.cumsum(counts) - counts)
            hidden_pad = len(words) if len(words) < len(used) else -1
            out, state = net.forward(net.project(x), local, hidden_pad, keep=True)
            target = y[document[chosen[a : a + batch]]]
            grads, dprojected = net.backward((sigmoid(out) - target).astype(np.float32) / len(rows), local, state, len(used))
            dx = np.zeros_like(x)
            for d in "fb":
                grads["W" + d], grads["c" + d] = x.T @ dprojected[d], dprojected[d].sum(axis=0)
                dx += dprojected[d] @ net.p["W" + d].T
            dx = dx[: len(words)]
            grads["word"] = summed(ids[words], dx[:, :WORD_DIM], len(net.p["word"]))
            grads["char"] = summed(own, np.repeat(dx[:, WORD_DIM:] / np.maximum(counts, 1)[:, None], counts, axis=0), 1 << BUCKET_BITS)
            for k in ("word", "char"):
                grads[k] += 1e-5 * net.p[k]
            adam.apply(grads)
    most = np.full(len(texts), -np.inf)
    np.maximum.at(most, document, logits())
    net.slope, net.shift = calibrated(most[held], y[held]) if len(set(y[held].tolist())) == 2 else (1.0, 0.0)
    return net


def calibrated(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope (0.1 to 3) and shift of a logistic curve through ``values``, both classes weighing alike, by Newton steps."""
    weight = np.where(labels > 0, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))
    slope, shift, prior = 1.0, 0.0, 0.002
    for _ in range(50):
        q = sigmoid(slope * values + shift)
        e, c = weight * (q - labels), weight * q * (1 - q) + 1e-9
        g = np.array([(e * values).sum() + prior * (slope - 1), e.sum() + prior * shift])
        h = np.array([[(c * values * values).sum() + prior, (c * values).sum()], [(c * values).sum(), c.sum() + prior]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, shift = float(np.clip(slope - step[0], 0.1, 3)), float(shift - step[1])
    return slope, shift

