"""A small causal self-attention model over subword ids, in numpy.

Texts are cut into blocks of ``STRIDE`` ids. One attention layer with ``SIZE`` dimensions
reads a window of two blocks and scores the second, so windows overlap, and each id is
scored once, with a whole block of ids before it where the text has them; how far an id
lies back adds to its weight. The output is factored: a softmax over ``CLASSES`` classes of
ids, and each id's share of its class after ids of the kind of the one before. Classes,
kinds and the first embeddings come from the ids' neighbours: random codes of the ids
before and after are added up per id, and these sums are clustered.

Everything that is learned from many texts is a sum of arrays, so tasks work on their own
rows and their sums are added.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SIZE = 16
STRIDE = 16
WINDOW = 2 * STRIDE
CLASSES = 64
CODES = 24  # random code of an id, for each side
KINDS = 256  # of the id before, for an id's share of its class
BACKED = 5.0  # occurrences that the share without the id before stands for
ALPHA = 0.1  # occurrences of an id that are added to its count within its class
RATE = 0.15
BATCH = 128  # windows of a training step
LEAST_STEPS = 100  # of a task in a round: passes over few windows are repeated
SCORED = 192  # windows scored at a time
PENALTY = np.float32(30.0)  # scores lie within plus and minus this
BACK = np.arange(STRIDE)[:, None] + STRIDE - np.arange(WINDOW)[None, :]  # how far a place lies back; less than 0 is ahead


# ---------------------------------------------------------------- windows


def inputs_of(ids: np.ndarray, lengths: np.ndarray, start_id: int) -> np.ndarray:
    """The id before each id; ``start_id`` before the first of a text."""
    out = np.empty(len(ids), np.int64)
    out[1:] = ids[:-1]
    out[(np.cumsum(lengths) - lengths)[lengths > 0]] = start_id
    return out


def blocks_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Texts in blocks, each text behind a blank block: the place of every id, the first
    block of each text that has ids, and the number of blocks."""
    blocks = 1 + -(-lengths // STRIDE)
    before = np.cumsum(blocks) - blocks
    start = np.cumsum(lengths) - lengths
    place = np.repeat((before + 1) * STRIDE - start, lengths) + np.arange(int(lengths.sum()))
    return place, before + 1, int(blocks.sum())


# ---------------------------------------------------------------- neighbours, classes


def neighbour_codes(n_ids: int) -> np.ndarray:
    return np.random.default_rng(5).standard_normal((n_ids, CODES)).astype(np.float32)


def neighbour_sums(ids: np.ndarray, inputs: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Of every id its count, and the codes of the ids before and after it added up."""
    n_ids = len(codes)
    out = np.zeros((n_ids, 1 + 2 * CODES))
    out[:, 0] = np.bincount(ids, minlength=n_ids)
    pairs, times = np.unique(inputs * n_ids + ids, return_counts=True)  # each pair of neighbours once
    before, after = pairs // n_ids, pairs % n_ids
    for k in range(CODES):
        out[:, 1 + k] = np.bincount(after, codes[before, k] * times, minlength=n_ids)
        out[:, 1 + CODES + k] = np.bincount(before, codes[after, k] * times, minlength=n_ids)
    return out


def clusters(points: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """One of ``n - 1`` clusters for each id that occurs twice or more; the others are in the last."""
    common, of = np.flatnonzero(counts > 1), np.full(len(counts), n - 1)
    centres = points[common[np.argsort(-counts[common], kind="stable")[: n - 1]]]
    for _ in range(12 if len(centres) else 0):
        apart = (centres**2).sum(axis=1) - 2 * points[common] @ centres.T
        of[common] = apart.argmin(axis=1)
        total = np.bincount(of[common], counts[common], minlength=len(centres))
        sums = [np.bincount(of[common], counts[common] * points[common, k], minlength=len(centres)) for k in range(SIZE)]
        centres = np.where(total[:, None] > 0, np.column_stack(sums) / np.maximum(total, 1)[:, None], centres)
    return of.astype(np.int64)


class IdClasses:
    """Classes of ids and each id's share of its class, from ``neighbour_sums`` of all tasks."""

    def __init__(self, sums: np.ndarray):
        counts = sums[:, 0]
        mean = sums[:, 1:].sum(axis=0) / max(counts.sum(), 1)
        # Rare ids are drawn to the mean.
        around = (sums[:, 1:] - counts[:, None] * mean) / (counts[:, None] + 5)
        weighted = around * np.sqrt(counts)[:, None]
        _, vectors = np.linalg.eigh(weighted.T @ weighted)
        points = around @ vectors[:, ::-1][:, :SIZE]
        points /= max(float(np.sqrt((points**2 * counts[:, None]).sum() / max(counts.sum(), 1) / SIZE)), 1e-9)
        self.points = points.astype(np.float32)
        self.class_of, self.kind_of = clusters(points, counts, CLASSES), clusters(points, counts, KINDS)
        in_class, members = np.bincount(self.class_of, counts, minlength=CLASSES), np.bincount(self.class_of, minlength=CLASSES)
        self.share = (counts + ALPHA) / (in_class + ALPHA * members)[self.class_of]

    def count_follows(self, out: np.ndarray, ids: np.ndarray, inputs: np.ndarray) -> None:
        """Add to ``out`` (ids, KINDS) how often each id follows each kind of id."""
        pairs, times = np.unique(ids * KINDS + self.kind_of[inputs], return_counts=True)
        out.ravel()[pairs] += times.astype(out.dtype)

    def follow_counts(self, ids: np.ndarray, inputs: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.share), KINDS), np.uint32)
        self.count_follows(out, ids, inputs)
        return out


class Shares:
    """log10 of each id's share of its class, after each kind of id. Only ids that were met
    while training have a row of their own."""

    def __init__(self, classes: IdClasses, follow: np.ndarray | None):
        self.class_of, self.kind_of = classes.class_of.astype(np.int32), classes.kind_of.astype(np.int32)
        share = classes.share.astype(np.float32)
        known = follow.any(axis=1) if follow is not None else np.zeros(len(share), bool)
        self.row_of = np.where(known, np.cumsum(known) - 1, -1).astype(np.int32)
        rows = follow[known].astype(np.float32) if follow is not None else np.zeros((0, KINDS), np.float32)
        self.rows = np.log10(rows + np.float32(BACKED) * share[known][:, None])
        self.unmet = np.log10(np.float32(BACKED) * share)
        of_class = np.zeros((CLASSES, KINDS))
        np.add.at(of_class, classes.class_of[known], rows)
        self.of_class = np.log10(of_class + BACKED).astype(np.float32)

    def logs(self, ids: np.ndarray, inputs: np.ndarray) -> np.ndarray:
        kind, row = self.kind_of[inputs], self.row_of[ids]
        out = self.rows[np.maximum(row, 0), kind] if len(self.rows) else np.zeros(len(ids), np.float32)
        out = np.where(row >= 0, out, self.unmet[ids])
        return out - self.of_class[self.class_of[ids], kind]


# ---------------------------------------------------------------- the network


@dataclass
class Network:
    embedding: np.ndarray  # (ids + 1, SIZE); the last row is the blank
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    back: np.ndarray  # (WINDOW,), for each distance
    out: np.ndarray  # (SIZE, CLASSES)
    bias: np.ndarray

    @classmethod
    def first(cls, points: np.ndarray) -> Network:
        rng = np.random.default_rng(9)

        def near(rows: int, columns: int, scale: float) -> np.ndarray:
            return (scale * rng.standard_normal((rows, columns))).astype(np.float32)

        rows = np.concatenate([0.5 * points, np.zeros((1, SIZE), np.float32)])
        square = [near(SIZE, SIZE, 0.3) for _ in range(3)]
        return cls(rows, *square, np.linspace(0, -2, WINDOW).astype(np.float32), near(SIZE, CLASSES, 0.1), np.zeros(CLASSES, np.float32))

    def dense(self) -> list[np.ndarray]:
        return [self.query, self.key, self.value, self.back, self.out, self.bias]

    def copy(self) -> Network:
        return Network(self.embedding.copy(), *[a.copy() for a in self.dense()])

    def weights_back(self) -> np.ndarray:
        """What a place's weight is multiplied by, for its distance; nothing ahead counts."""
        return np.where(BACK >= 0, np.exp(self.back[np.maximum(BACK, 0)]), 0).astype(np.float32)

    def moved(self, sums: dict[str, np.ndarray]) -> Network:
        """By the mean of the tasks' changes; an embedding's is that of the tasks that changed it."""
        tasks = sums["tasks"][0, 0]
        dense = [a + (sums[f"dense{k}"].reshape(a.shape) / tasks).astype(np.float32) if f"dense{k}" in sums else a for k, a in enumerate(self.dense())]
        rows = (sums["rows"] / np.maximum(sums["touched"], 1)).astype(np.float32)
        return Network(self.embedding + rows, *dense)


def _exp(scores: np.ndarray) -> np.ndarray:
    """2 ** (score / ln 2), linear between whole powers of two: the score goes to a float's
    exponent bits. What is divided by its sum is a distribution all the same."""
    np.clip(scores, -PENALTY, PENALTY, out=scores)
    scores *= np.float32((1 << 23) / np.log(2))
    scores += np.float32(127 << 23)
    return scores.astype(np.int32).view(np.float32)


class Trainer:
    """Steps of gradient descent over windows, with a rate per parameter that falls as its
    gradients add up. Texts come in pieces of any number; what is kept between them has the
    size of the network."""

    def __init__(self, net: Network, class_of: np.ndarray, rate: float, seed: int):
        self.net, self.class_of, self.rate = net, class_of.astype(np.int32), rate
        self.rng, self.touched, self.steps = np.random.default_rng(seed), np.zeros(len(net.embedding), bool), 0
        self.past = [np.full(a.shape, 0.1, np.float32) for a in net.dense()]
        self.past_rows = np.full(len(net.embedding), 0.1, np.float32)

    def learn(self, ids: np.ndarray, inputs: np.ndarray, lengths: np.ndarray) -> None:
        """One pass over the windows of these texts, in random order; the first texts of a
        task are passed over again until it has made ``LEAST_STEPS``."""
        place, _, n_blocks = blocks_of(lengths)
        if not len(place):
            return
        flat, wanted = np.full(n_blocks * STRIDE, len(self.net.embedding) - 1, np.int32), np.zeros(n_blocks * STRIDE, np.int32)
        flat[place], wanted[place] = inputs, self.class_of[ids]
        holds = np.zeros(n_blocks, bool)
        holds[place // STRIDE] = True
        scored = np.flatnonzero(holds)
        del place
        while True:
            order = self.rng.permutation(scored)
            for at in range(0, len(order), BATCH):
                here = order[at : at + BATCH, None] * STRIDE + np.arange(-STRIDE, STRIDE)
                self._step(flat[here], wanted[here[:, STRIDE:]].ravel())
            if self.steps >= LEAST_STEPS:
                return

    def _step(self, around: np.ndarray, target: np.ndarray) -> None:
        net, blank, n = self.net, len(self.net.embedding) - 1, len(around)
        scale = np.float32(SIZE**-0.5)
        seen = (around != blank).astype(np.float32)
        counted = seen[:, STRIDE:].ravel()
        x = net.embedding[around.ravel()]
        project = np.concatenate([net.query * scale, net.key, net.value], axis=1)
        qkv = (x @ project).reshape(n, WINDOW, 3 * SIZE)
        q, k, v = qkv[:, STRIDE:, :SIZE], qkv[:, :, SIZE : 2 * SIZE], qkv[:, :, 2 * SIZE :]
        a = _exp(q @ k.transpose(0, 2, 1))
        a *= net.weights_back()
        a *= seen[:, None, :]
        a /= np.maximum(a.sum(axis=2, keepdims=True), np.float32(1e-20))
        tail = x.reshape(n, WINDOW, SIZE)[:, STRIDE:]
        h = (tail + a @ v).reshape(-1, SIZE)
        p = h @ net.out
        p += net.bias
        p = _exp(p)

        # From here on p is the gradient of the scores of the classes.
        share = counted / np.float32(counted.sum())
        p *= (share / p.sum(axis=1))[:, None]
        p[np.arange(len(p)), target] -= share
        d_h = p @ net.out.T
        d_heads = d_h.reshape(n, STRIDE, SIZE)
        d_s = d_heads @ v.transpose(0, 2, 1)
        d_s -= (d_s * a).sum(axis=2, keepdims=True)
        d_s *= a
        d_back = np.bincount(np.maximum(BACK, 0).ravel(), d_s.sum(axis=0).ravel(), minlength=WINDOW).astype(np.float32)
        d_qkv = np.zeros((n, WINDOW, 3 * SIZE), np.float32)
        d_qkv[:, STRIDE:, :SIZE] = d_s @ k
        d_qkv[:, :, SIZE : 2 * SIZE] = d_s.transpose(0, 2, 1) @ q
        d_qkv[:, :, 2 * SIZE :] = a.transpose(0, 2, 1) @ d_heads
        d_qkv = d_qkv.reshape(-1, 3 * SIZE)
        d_x = d_qkv @ project.T
        d_x.reshape(n, WINDOW, SIZE)[:, STRIDE:] += d_heads
        d_x *= seen.reshape(-1, 1)
        d_project = x.T @ d_qkv
        grads = [
            d_project[:, :SIZE] * scale,
            d_project[:, SIZE : 2 * SIZE],
            d_project[:, 2 * SIZE :],
            d_back,
            h.T @ p,
            p.sum(axis=0),
        ]
        for value, grad, sums in zip(net.dense(), grads, self.past):
            grad = grad * np.float32(10)
            sums += grad * grad
            value -= np.float32(self.rate) * grad / np.sqrt(sums)
        placed = np.sort(around.ravel().astype(np.int64) * around.size + np.arange(around.size))
        ordered, row_of = placed % around.size, placed // around.size
        starts = np.flatnonzero(np.diff(row_of, prepend=-1))
        rows = row_of[starts]
        grad = np.float32(100) * np.add.reduceat(d_x[ordered], starts, axis=0)
        self.past_rows[rows] += (grad * grad).mean(axis=1)
        net.embedding[rows] -= np.float32(self.rate) * grad / np.sqrt(self.past_rows[rows])[:, None]
        net.embedding[blank] = 0
        self.touched[rows] = True
        self.touched[blank] = False
        self.steps += 1


def train(net: Network, ids: np.ndarray, inputs: np.ndarray, lengths: np.ndarray, class_of: np.ndarray, rate: float, seed: int) -> np.ndarray:
    """Learn from texts that are there as a whole. Changes ``net``; returns which embeddings were changed."""
    trainer = Trainer(net, class_of, rate, seed)
    trainer.learn(ids, inputs, lengths)
    return trainer.touched


class Scorer:
    """A trained network with its projections folded into one table, for scoring."""

    def __init__(self, net: Network, classes: IdClasses, follow: np.ndarray | None):
        # Of each id: query, itself, key, value, and a one that adds up the weights of attention.
        one, scale = np.ones((len(net.embedding), 1), np.float32), np.float32(SIZE**-0.5)
        self.rows = np.concatenate([net.embedding @ net.query * scale, net.embedding, net.embedding @ net.key, net.embedding @ net.value, one], axis=1)
        self.weights, self.out, self.bias = net.weights_back(), net.out, net.bias
        self.shares = Shares(classes, follow)
        self.in_use = (np.bincount(classes.class_of, minlength=CLASSES) > 0).astype(np.float32)

    def id_scores(self, ids: np.ndarray, lengths: np.ndarray, start_id: int) -> np.ndarray:
        """log10 of the probability of each id, given those before it in its window."""
        inputs = inputs_of(ids, lengths, start_id)
        place, first, n_blocks = blocks_of(lengths)
        flat, wanted = np.full(n_blocks * STRIDE, len(self.rows) - 1, np.int32), np.zeros(n_blocks * STRIDE, np.int32)
        flat[place], wanted[place] = inputs, self.shares.class_of[ids]
        is_first = np.zeros(n_blocks, bool)
        is_first[first[lengths > 0]] = True
        ratio = np.empty((n_blocks, STRIDE), np.float32)
        for at in range(1, n_blocks, SCORED):
            stop = min(at + SCORED, n_blocks)
            n = stop - at
            x = self.rows[flat[(at - 1) * STRIDE : stop * STRIDE]]
            own = x[STRIDE:].reshape(n, STRIDE, -1)
            # Windows overlap in memory as they do in the text.
            around = np.lib.stride_tricks.as_strided(x, (n, WINDOW, x.shape[1]), (STRIDE * x.strides[0], *x.strides), writeable=False)
            a = _exp(own[:, :, :SIZE] @ around[:, :, 2 * SIZE : 3 * SIZE].transpose(0, 2, 1))
            a *= self.weights
            a[is_first[at:stop], :, :STRIDE] = 0
            h = a @ around[:, :, 3 * SIZE :]
            met = h[:, :, :SIZE] / h[:, :, SIZE:]
            met += own[:, :, SIZE : 2 * SIZE]
            p = met.reshape(-1, SIZE) @ self.out
            p += self.bias
            p = _exp(p)
            chosen = p[np.arange(len(p)), wanted[at * STRIDE : stop * STRIDE]]
            ratio[at:stop] = (chosen / (p @ self.in_use)).reshape(n, STRIDE)
        return np.log10(ratio.ravel()[place]).astype(float) + self.shares.logs(ids, inputs)
