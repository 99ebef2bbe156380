"""Toxicity by subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word's bag holds the hash of the word and of its character n-grams (bytes, between word marks), so an unseen
misspelling shares most vectors with the word it stands for. A passage's features are the mean of the vectors in
its bags; a linear softmax over two classes reads them. A document is scored by its most toxic passage of
``PASSAGE`` words (half overlapping), so a few words count as much in a long text as in a short one; training
follows the same passage: its gradient goes to the ``TOP`` passages that score highest, at last to the highest
alone, which is how a label of a whole text teaches passages.

Vectors and softmax act together as one weight a hash (the difference of the classes), so scoring adds up one
number a hash, in time linear in the text. Only the text is an input of the score.

Defined cases: null or empty text scores what the bias alone gives; texts are read whole; repeated rows are
scored each; labels that are null or other than 0 and 1 are not learned; without both labels every score is
0; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import map_arrow, only
from .text_arrays import LETTERS, Block, blocks, lowered, mixed, powers

BUCKETS, DIM, GRAMS, PASSAGE, SAMPLE, EPOCHS, RATE, SEED = 1 << 18, 8, (3, 4, 5), 6, 4_000, 18, 60.0, 5
TOP, EARLY, SHRINK = 4, 0.35, 0.94
THRESHOLD = 0.7
#: No text over so many bytes is learned from, so a sample of 4,000 rows has at most 128 MB.
SAMPLE_BYTES = 32_768


def subwords(b: Block, lower: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of each member of each word's bag."""
    marked = np.where(LETTERS[b.raw], lower, 0)  # whatever stands around a word marks its ends
    p, inverse = powers(len(marked) + 2)
    s = b.sums((marked.astype(np.uint64) + np.uint64(1)) * p[: len(marked)])
    first, last = np.maximum(b.begin - 1, 0), np.minimum(b.end + 1, len(marked))
    whole = mixed((s[b.end] - s[b.begin]) * inverse[b.begin])
    got, word = [whole], [np.arange(len(b.begin))]
    for n in GRAMS:
        many = np.maximum(last - first - n + 1, 0)
        w = np.repeat(np.arange(len(many)), many)
        at = np.repeat(first - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(len(w))
        got.append(mixed((s[at + n] - s[at]) * inverse[at] + np.uint64(n)))
        word.append(w)
    return (np.concatenate(got) % np.uint64(buckets)).astype(np.int64), np.concatenate(word)


def passages(b: Block, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, text) of each passage; the last one of a text is whole, not short, where it can be."""
    n = np.bincount(b.of, minlength=b.texts)
    start = np.concatenate(([0], np.cumsum(n)[:-1]))
    step = size // 2
    many = np.where(n > 0, np.maximum(1, -(-(n - size) // step) + 1), 0)
    of = np.repeat(np.arange(b.texts), many)
    k = np.arange(len(of)) - np.repeat(np.concatenate(([0], np.cumsum(many)[:-1])), many)
    first = start[of] + np.minimum(k * step, np.maximum(n[of] - size, 0))
    return first, np.minimum(first + size, start[of] + n[of]), of


def scores(texts: list[str | None], weight: np.ndarray, bias: float) -> np.ndarray:
    """P(toxic) of each text: the highest of its passages."""
    out = np.full(len(texts), 1 / (1 + np.exp(-bias)))
    for first, b in blocks(texts, LETTERS, 1 << 19):
        if not len(b.begin):
            continue
        bucket, word = subwords(b, lowered(b.raw), len(weight))
        sums = np.bincount(word, weights=weight[bucket], minlength=len(b.begin))
        sizes = np.bincount(word, minlength=len(b.begin))
        s, n = np.concatenate(([0], np.cumsum(sums))), np.concatenate(([0], np.cumsum(sizes)))
        a, z, of = passages(b)
        logit = (s[z] - s[a]) / (n[z] - n[a]) + bias
        best = np.full(b.texts, -np.inf)
        np.maximum.at(best, of, logit)
        known = np.isfinite(best)
        out[first + np.flatnonzero(known)] = 1 / (1 + np.exp(-np.clip(best[known], -60, 60)))
    return out


def train(texts: list[str | None], toxic: np.ndarray, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias): vectors E and softmax W trained together by stochastic gradient descent,
    returned as E (W1 - W0). Plain steps, so what is seen once moves little against what returns."""
    if not len(texts) or toxic.min() == toxic.max():
        return np.zeros(buckets, np.float32), -60.0
    rng = np.random.default_rng(seed)
    E = rng.normal(0, 0.01, (buckets, dim)).astype(np.float32)
    W = np.tile(np.array([-0.5, 0.5], np.float32), (dim, 1))
    bias = np.array([0.0, -2.0], np.float32)
    order = rng.permutation(len(texts))
    bags = []
    for first, b in blocks([texts[i] for i in order], LETTERS, 1 << 16):
        if len(b.begin):
            bucket, word = subwords(b, lowered(b.raw), buckets)
            by = np.argsort(word, kind="stable")
            edge = np.searchsorted(word[by], np.arange(len(b.begin) + 1))
            a, z, of = passages(b)
            bags.append((bucket[by].astype(np.int32), edge[a], edge[z], of, toxic[order[first : first + b.texts]]))
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        E *= np.float32(SHRINK)
        for g in rng.permutation(len(bags)):
            bucket, a, z, of, y = bags[g]
            one = E @ (W[:, 1] - W[:, 0])
            s = np.concatenate(([0], np.cumsum(one[bucket], dtype=np.float64)))
            logit = (s[z] - s[a]) / (z - a) + float(bias[1] - bias[0])
            pick = np.lexsort((-logit, of))
            new = np.concatenate(([True], of[pick][1:] != of[pick][:-1]))
            place = np.arange(len(pick)) - np.maximum.accumulate(np.where(new, np.arange(len(pick)), 0))
            pick = pick[place < (TOP if epoch < EARLY * epochs else 1)]  # each text's highest passages
            low, many = a[pick], (z - a)[pick]
            err = 1 / (1 + np.exp(-np.clip(logit[pick], -30, 30))) - y[of[pick]]
            row = np.repeat(np.arange(len(many)), many)
            member = bucket[np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(len(row))]
            used, back = np.unique(member, return_inverse=True)
            gain = np.bincount(back, weights=(err / many)[row]).astype(np.float32)
            to_w = E[used].T @ gain
            E[used] -= lr * gain[:, None] * (W[:, 1] - W[:, 0])
            W[:, 1] -= 0.01 * to_w / len(many)
            W[:, 0] += 0.01 * to_w / len(many)
            bias[1] -= np.float32(0.02 * err.mean())
    return E @ (W[:, 1] - W[:, 0]), float(bias[1] - bias[0])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, sample: int, key: str, most_bytes: int = SAMPLE_BYTES) -> tuple[list, np.ndarray]:
    """At most ``sample`` labelled rows that may be learned, half of them of either label at most, with whole
    texts of up to ``most_bytes``, in order of a hash of the id."""
    lab = only(labels, key, label).where(F.col(label).isin(0, 1) & learn & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    by = (F.xxhash64("_key"), "_key")
    half = [lab.where(F.col("_label") == x).orderBy(*by).limit(sample // 2) for x in (0, 1)]
    d = only(docs, key, "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
    rows = d.join(F.broadcast(half[0].unionByName(half[1])), d[key] == F.col("_key")).orderBy(*by, "_label", "text").select("text", "_label").limit(sample)
    got = rows.collect()
    return [r[0] for r in got], np.array([r[1] for r in got], int)


def score_column(docs: DataFrame, model, key: str, name: str = "score") -> DataFrame:
    """(key, score) of every row, where model() returns the function on a list of texts."""
    d = only(docs, key, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(b.column(1).to_pylist()), pa.float64())], names=[key, name])

    return map_arrow(d, run, T.StructType([d.schema[key], T.StructField(name, T.DoubleType(), False)]))


def score_documents(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """(key, score) of every row of docs, learned from the rows of labels that ``learn`` allows."""
    texts, toxic = labelled_sample(docs, labels, "toxic", learn, sample, key)
    shared = docs.sparkSession.sparkContext.broadcast(train(texts, toxic))

    def model():
        weight, bias = shared.value
        return lambda texts: scores(texts, weight, bias)

    return score_column(docs, model, key)
