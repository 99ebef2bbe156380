"""Quality by a factorisation machine over hashed words, structure statistics and text metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairs of features
interact through vectors of rank ``RANK``, in time linear in a text's features by the sum-of-squares identity.
Features are the text's hashed words (weights of length one), statistics of its structure and its sizes; only
the text is an input. Learned by stochastic gradient descent on a bounded sample of labelled rows.

Defined cases: null or empty text has zero statistics and is scored from these; texts are read whole; repeated
rows are scored each; labels that are null or other than 0 and 1 are not learned; without both labels every
score is 1; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from .text_arrays import NO_SPACE, Block, blocks, lowered, mixed
from .toxicity import labelled_sample, score_column

BUCKETS, RANK, SAMPLE, EPOCHS, RATE, DECAY, SEED = 1 << 18, 8, 4_000, 15, 0.05, 1e-5, 3
THRESHOLD = 0.3
STATISTICS = (
    "log_words", "log_bytes", "word_bytes", "symbols", "bars", "marks", "capitals", "digits", "breaks", "adjacent", "distinct", "threes", "line_copies", "one_byte_words"
)


def _distinct(of: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many different h each text has."""
    by = np.lexsort((h, of))
    o, x = of[by], h[by]
    new = np.concatenate((np.ones(min(1, len(o)), bool), (o[1:] != o[:-1]) | (x[1:] != x[:-1])))
    return np.bincount(o[new], minlength=n)


def features(b: Block, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of each text's words, and the statistics, one row a text."""
    n, raw, low = b.texts, b.raw, lowered(b.raw)
    h = b.hashes(low)
    words = np.bincount(b.of, minlength=n)
    at_least = np.maximum(words, 1)
    begin = np.concatenate(([0], b.text_end[:-1] + 1))
    size = b.text_end - begin
    chars = np.maximum(size, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        s = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (s[b.text_end] - s[begin]) / chars

    def of_bytes(some: bytes) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(some)] = True
        return share(table[raw])

    same = (b.of[1:] == b.of[:-1]) & (h[1:] == h[:-1])
    three = mixed(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)) if len(h) > 2 else h[:0]
    inside = b.of[2:] == b.of[:-2]
    threes, of3 = three[inside], b.of[: len(three)][inside]
    ends = np.flatnonzero(raw == 10)
    line = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    lines = Block(raw, b.text_end, line, ends, np.searchsorted(b.text_end, ends))
    full = ends - line > 3
    line_hash, line_of = lines.hashes(low)[full], lines.of[full]
    n_lines = np.bincount(line_of, minlength=n)
    length = b.end - b.begin
    stats = np.stack(
        [
            np.log1p(words), np.log1p(size), np.bincount(b.of, weights=length, minlength=n) / at_least, of_bytes(b"#*$%&<>~^=_\\"), of_bytes(b"|"), of_bytes(b"!?"),
            share((raw >= 65) & (raw <= 90)), share((raw >= 48) & (raw <= 57)), of_bytes(b"\n"), np.bincount(b.of[1:][same], minlength=n) / at_least,
            1 - _distinct(b.of, h, n) / at_least, (np.bincount(of3, minlength=n) - _distinct(of3, threes, n)) / at_least,
            (n_lines - _distinct(line_of, line_hash, n)) / np.maximum(n_lines, 1), np.bincount(b.of[length == 1], minlength=n) / at_least,
        ],
        axis=1,
    )
    stats[words == 0, 10] = 0
    key, many = np.unique(b.of.astype(np.int64) * buckets + (h % np.uint64(buckets)).astype(np.int64), return_counts=True)
    of = key // buckets
    value = np.sqrt(many / at_least[of])
    return of, key % buckets, value, stats


def _sums(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of rows of values (sorted by of) a text."""
    edge = np.searchsorted(of, np.arange(n + 1))
    s = np.concatenate((np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)))
    return s[edge[1:]] - s[edge[:-1]]


class Machine:
    def __init__(self, buckets: int, rank: int, seed: int):
        rng = np.random.default_rng(seed)
        self.buckets, k = buckets, len(STATISTICS)
        self.w0, self.w = 0.0, np.zeros(buckets + k, np.float32)
        self.v = rng.normal(0, 0.02, (buckets + k, rank)).astype(np.float32)
        self.mean, self.scale = np.zeros(k), np.ones(k)

    def inputs(self, b: Block):
        of, bucket, value, stats = features(b, self.buckets)
        return of, bucket, value, np.clip((stats - self.mean) / self.scale, -4, 4)

    def parts(self, of, bucket, value, stats):
        """The linear part, the sums over features of v x, and of (v x)^2."""
        n, B = len(stats), self.buckets
        vx = self.v[bucket] * value[:, None]
        linear = self.w0 + np.bincount(of, weights=self.w[bucket] * value, minlength=n) + stats @ self.w[B:]
        total = _sums(of, vx, n) + stats @ self.v[B:]
        squares = _sums(of, vx * vx, n) + (stats**2) @ (self.v[B:] ** 2)
        return linear, total, squares

    def logit(self, inputs) -> np.ndarray:
        linear, total, squares = self.parts(*inputs)
        return linear + 0.5 * (total**2 - squares).sum(axis=1)

    def step(self, inputs, y: np.ndarray, rate: float, decay: float) -> None:
        of, bucket, value, stats = inputs
        linear, total, squares = self.parts(*inputs)
        p = 1 / (1 + np.exp(-np.clip(linear + 0.5 * (total**2 - squares).sum(axis=1), -30, 30)))
        err = (p - y) / len(y)
        B = self.buckets
        grad_v = err[of, None] * (value[:, None] * total[of] - self.v[bucket] * (value**2)[:, None])
        self.w0 -= rate * err.sum()
        np.add.at(self.w, bucket, (-rate * err[of] * value).astype(np.float32))
        np.add.at(self.v, bucket, (-rate * grad_v).astype(np.float32))
        self.w[B:] -= rate * (err @ stats + decay * self.w[B:])
        self.v[B:] -= rate * (stats.T @ (err[:, None] * total) - (stats**2).T @ err[:, None] * self.v[B:] + decay * self.v[B:])


def train(texts: list[str | None], good: np.ndarray, buckets: int = BUCKETS, rank: int = RANK, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Machine | None:
    if not len(texts) or good.min() == good.max():
        return None
    m = Machine(buckets, rank, seed)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    batches, raw = [], []
    for at in range(0, len(order), 32):
        rows = order[at : at + 32]
        for first, b in blocks([texts[i] for i in rows], NO_SPACE, 1 << 24):
            of, bucket, value, stats = features(b, buckets)
            batches.append((of.astype(np.int32), bucket.astype(np.int32), value.astype(np.float32), stats, good[rows[first : first + b.texts]]))
            raw.append(stats)
    stats = np.concatenate(raw)
    m.mean, m.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
    for epoch in range(epochs):
        for g in rng.permutation(len(batches)):
            of, bucket, value, stats, y = batches[g]
            m.step((of, bucket, value, np.clip((stats - m.mean) / m.scale, -4, 4)), y, rate * 4 / (1 + epoch / 4), DECAY)
    return m


def scores(texts: list[str | None], m: Machine | None) -> np.ndarray:
    if m is None:
        return np.ones(len(texts))
    out = np.empty(len(texts))
    for first, b in blocks(texts, NO_SPACE, 1 << 19):
        out[first : first + b.texts] = 1 / (1 + np.exp(-np.clip(m.logit(m.inputs(b)), -30, 30)))
    return out


def score_documents(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """(key, score) of every row of docs, learned from the rows of labels that ``learn`` allows."""
    texts, good = labelled_sample(docs, labels, "quality", learn, sample, key)
    shared = docs.sparkSession.sparkContext.broadcast(train(texts, good))

    def model():
        m = shared.value
        return lambda texts: scores(texts, m)

    return score_column(docs, model, key)
