"""SimHash near-duplicates: fingerprints linked by BK-trees over shards, then connected components.

A fingerprint takes the majority bit of the XXH64 hashes of a text's word shingles. Two fingerprints that
differ in at most ``radius`` bits agree, when their 64 bits are cut into ``blocks`` parts, in at least
``blocks - radius`` whole parts; each choice of that many parts names a shard, so every linked pair meets in a
shard. A shard's distinct fingerprints form one BK-tree (children keyed by their Hamming distance to the
parent) and are searched in it along edges within the radius alone. Shards over ``shard_limit`` fingerprints
are dealt again by ``fine_blocks`` parts, where a shard holds few bits that are free, so no shard grows with
the input. A shard returns a star (fingerprint, root) for each component of its own: links within a group are
never written out as pairs. Stars are joined into components over all shards. Shards grow with the corpus, so they
are dealt to tasks, none is sent to all.

``near`` links texts of a Jaccard similarity of 0.8 or more over five-word shingles. Two bits of 64 cannot show that
(edited copies differ in ten), so fingerprints have 256 bits there and link within 48. No shards and no tree part so wide
a radius (fingerprints that are not alike all differ in about 128 bits), so every fingerprint is compared with every other, a
pair of parts of the table a task. Pairs somewhat below 0.8 link as well.

Defined cases: null or empty texts, or texts without a word, have fingerprint 0 and link like any other;
fewer words than a shingle make one shingle; repeated rows and equal texts share fingerprint and component;
a null id is never the smallest; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import by_place, kept_by, map_arrow, only, written
from .text_arrays import NO_SPACE, blocks, lowered, mixed

SHINGLE, RADIUS, BLOCKS, FINE_BLOCKS, SHARD_LIMIT = 3, 2, 4, 8, 65_536
HOT_ROWS, FEW_SHARDS = 10_000, 100_000
#: Wide fingerprints: words in a shingle, 64-bit words, and the radius. Texts of Jaccard similarity 0.8 agree in a share of
#: 0.848 of the bits (shared weight 2 * 0.8 / 1.8, so 1 - acos(0.889) / pi; 39 of 256 differ, and one in sixteen pairs over 48).
NEAR_SHINGLE, NEAR_WORDS, NEAR_RADIUS = 5, 4, 48
#: Parts that fingerprints are dealt to for comparing: of NEAR_LIMIT at least, NEAR_PARTS parts, of NEAR_MOST at most.
NEAR_LIMIT, NEAR_PARTS, NEAR_MOST = 512, 24, 1_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z and ASCII white space only, on bytes
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    ones, n = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, 65_536):  # bounded memory for very long texts
        to = min(n, at + 65_536)
        h = np.array([digest(view[a:b], seed) for a, b in zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist())], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _bounds(blocks: int) -> list[tuple[int, int]]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return list(zip(edges[:-1], edges[1:]))


def shard_keys(fp, blocks: int, radius: int):
    """One (choice, bits) struct a choice of ``blocks - radius`` parts: the bits of the chosen parts alone."""
    masks = []
    for choice in combinations(_bounds(blocks), blocks - radius):
        m = sum(((1 << b) - 1) ^ ((1 << a) - 1) for a, b in choice)
        masks.append(m - (1 << 64) if m >= 1 << 63 else m)
    return F.array(*[F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(masks)])


class BKForest:
    """BK-trees of many shards, built and searched level by level in arrays. Row i is a node; the first row of
    a shard is its root. ``child`` rows are sorted by (parent, distance to the parent)."""

    def __init__(self, fp: np.ndarray, shard: np.ndarray):
        """fp: one row a fingerprint, as many 64-bit words as it has."""
        self.fp = fp
        first = np.concatenate(([True], shard[1:] != shard[:-1]))
        self.root = np.maximum.accumulate(np.where(first, np.arange(len(fp)), 0))
        self.size = np.bincount(self.root, minlength=len(fp))[self.root]
        rest = np.flatnonzero(~first)
        parent, node, edge = self.root[rest], [], []
        above, most = [], 64 * fp.shape[1] + 1
        while len(rest):
            d = self.distance(rest, parent)
            _, at, group = np.unique(parent * most + d, return_index=True, return_inverse=True)
            node.append(rest[at])
            above.append(parent[at])
            edge.append(d[at])
            keep = np.ones(len(rest), bool)
            keep[at] = False
            parent, rest = rest[at][group][keep], rest[keep]
        none = [np.empty(0, np.int64)]
        node, above, edge = (np.concatenate(x or none) for x in (node, above, edge))
        order = np.lexsort((edge, above))
        self.child, self.edge, above = node[order], edge[order], above[order]
        self.begin = np.searchsorted(above, np.arange(len(fp) + 1))

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(self.fp[a, k] ^ self.fp[b, k]).astype(np.int64) for k in range(self.fp.shape[1]))

    def links(self, radius: int, visits: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays of (row, other row of its shard within the radius), other > row. Rows are searched together as
        long as they have at most about ``visits`` nodes to visit."""
        cost, at = np.cumsum(self.size), 0
        while at < len(self.fp):
            to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + visits)))
            q = np.arange(at, min(to, len(self.fp)))
            at, q = to, q[self.size[q] > 1]
            n = self.root[q]
            while len(q):
                d = self.distance(q, n)
                hit = (d <= radius) & (n > q)
                if hit.any():
                    yield q[hit], n[hit]
                lo, many = self.begin[n], self.begin[n + 1] - self.begin[n]
                c = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
                q, d = np.repeat(q, many), np.repeat(d, many)
                near = np.abs(self.edge[c] - d) <= radius
                q, n = q[near], self.child[c[near]]


def _merged(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Make ``low``, the smallest row linked to each row, hold for links between rows a and b as well."""
    while True:
        x, y = low[a], low[b]
        if (x == y).all():
            return
        m = np.minimum(x, y)
        np.minimum.at(low, x, m)
        np.minimum.at(low, y, m)
        while (low[low] != low).any():
            low[:] = low[low]


def joined_rows(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row linked to each row, over all links."""
    low = np.arange(n)
    for a, b in links:
        _merged(low, a, b)
    return low


def _places(near: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of truth values that are mostly false, looked through eight at a time."""
    flat = near.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    at = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return at[flat[at]]


def _link(fp: np.ndarray, low: np.ndarray, i: int, j: int, p: np.ndarray, q: np.ndarray, d: np.ndarray, radius: int) -> None:
    """Join rows i + p and j + q of fp in ``low`` where they are within the radius; d[p, q] is the distance of the first words."""
    far = d[p, q].astype(np.int64)
    for k in range(max(1, len(fp) // 2), len(fp)):
        far += np.bitwise_count(fp[k, i + p] ^ fp[k, j + q])
    some = np.flatnonzero((far <= radius) & (p + i != q + j))
    if len(some):
        _merged(low, p[some] + i, q[some] + j)


def joined_within(fp: np.ndarray, at: int, radius: int, rows: int = 8, wide: int = 8_192) -> np.ndarray:
    """The smallest row linked to each row of fingerprints fp(64-bit word, row): links are all pairs (row before ``at``, row
    from ``at``) within the radius; with ``at`` 0 all pairs. The first half of the words, compared for all, leaves few of
    those that are not alike; of those that are, pairs that are joined already are passed over."""
    n, half, low = fp.shape[1], max(1, len(fp) // 2), np.arange(fp.shape[1])
    x, d, e = np.empty((rows, wide), np.uint64), np.empty((rows, wide), np.uint8), np.empty((rows, wide), np.uint8)
    for i in range(0, at or n, rows):
        a = fp[:, i : min(i + rows, at or n)]
        for j in range(at or i, n, wide):
            b = fp[:, j : j + wide]
            high, width = a.shape[1], b.shape[1]
            part = (slice(0, high), slice(0, width))
            for k in range(half):
                np.bitwise_xor(a[k, :, None], b[k, None, :], out=x[part])
                np.bitwise_count(x[part], out=(e if k else d)[part])
                if k:
                    np.add(d[part], e[part], out=d[part])
            near = d[part] <= radius
            many = np.count_nonzero(near)
            if not many:
                continue
            hit = _places(near)
            if many > near.size // 32:  # of many alike a few join most
                _link(fp, low, i, j, *np.divmod(hit[:: max(1, near.size // 256)], width), d, radius)
                near &= low[i : i + high, None] != low[None, j : j + width]
                hit = _places(near)
            _link(fp, low, i, j, *np.divmod(hit, width), d, radius)
    return low


def _stars(radius: int, words: int):
    """(choice, bits, fp, words of the fingerprint) sorted by shard -> (a, b): each fp linked in its shard, with its
    root there."""

    def forest(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        choice, bits, fp, *parts = cols
        shard = np.cumsum(np.concatenate(([0], (choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1]))))
        low = joined_rows(len(fp), BKForest(np.stack(parts, axis=1).view(np.uint64), shard).links(radius))
        own = np.flatnonzero(low != np.arange(len(fp)))
        if not len(own):
            return None
        return pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[low[own]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("simhash")
        held: list[np.ndarray] = [np.empty(0, np.int64)] * (3 + words)
        for b in batches:
            cols = [np.concatenate((h, c.to_numpy(zero_copy_only=False).astype(np.int64))) for h, c in zip(held, b.columns)]
            cut = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
            end = int(cut[-1]) + 1 if len(cut) else 0  # the last shard may go on in the next batch
            if end and (out := forest([c[:end] for c in cols])):
                yield out
            held = [c[end:] for c in cols]
        if len(held[0]) and (out := forest(held)):
            yield out

    return run


def _trees(keys: DataFrame, radius: int) -> DataFrame:
    """(a, b) of the shards in keys(choice, bits, fp, words...)."""
    dealt = keys.repartition("choice", "bits").sortWithinPartitions("choice", "bits")
    return map_arrow(dealt, _stars(radius, len(keys.columns) - 3), "a long, b long")


def _large(keys: DataFrame, limit: int) -> DataFrame | None:
    """(choice, bits, n) of the shards over the limit, or None. Shards are counted with partial sums, not gathered."""
    large = written(keys.groupBy("choice", "bits").agg(F.count("*").alias("n")).where(F.col("n") > limit), "simhash-large")
    return None if large.isEmpty() else large


def _within(keys: DataFrame, large: DataFrame, how: str) -> DataFrame:
    """keys joined with the large shards, which are sent to all only where they are few."""
    few = large.count() <= FEW_SHARDS
    return keys.join(F.broadcast(large) if few else large, ["choice", "bits"], how)


def star_edges(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, fine_blocks: int = FINE_BLOCKS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """(a, b) over distinct fingerprints fps(fp), whose components are those of all links within the radius."""

    def keys(some: DataFrame, parts: int) -> DataFrame:
        k = some.select("fp", F.explode(shard_keys(F.col("fp"), parts, radius)).alias("k"))
        return k.select("k.choice", "k.bits", "fp", F.col("fp").alias("f0"))

    every = keys(fps, blocks)
    large = _large(every, shard_limit)
    if large is None:
        return _trees(every, radius)
    again = written(_within(every, large, "left_semi").select("fp").distinct(), "simhash-again")
    return _trees(_within(every, large, "left_anti"), radius).unionByName(_trees(keys(again, fine_blocks), radius))


def _pair_stars(radius: int, parts: int):
    """(pair, part, fp, words of the fingerprint) sorted by pair and part -> (a, b): each fp linked to one of the pair's other
    part (of the one part, where a pair is a part with itself), with its root among the pair's."""

    def forest(pair: int, held: list[list[np.ndarray]]) -> pa.RecordBatch | None:
        part, fp, *words = (np.concatenate(c) for c in held)
        at = 0 if pair // parts == pair % parts else int(np.searchsorted(part, part[-1]))
        if not at and pair // parts != pair % parts:
            return None  # one of the two parts is empty
        low = joined_within(np.stack(words).view(np.uint64), at, radius)
        own = np.flatnonzero(low != np.arange(len(fp)))
        if not len(own):
            return None
        return pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[low[own]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("simhash")
        pair, held = -1, []
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]
            edge = np.flatnonzero(np.concatenate(([True], cols[0][1:] != cols[0][:-1], [True]))) if len(cols[0]) else []
            for x, y in zip(edge, edge[1:]):
                if cols[0][x] != pair:
                    if held and (out := forest(pair, held)):
                        yield out
                    pair, held = int(cols[0][x]), [[] for _ in cols[1:]]
                for h, c in zip(held, cols[1:]):
                    h.append(c[x:y])
        if held and (out := forest(pair, held)):
            yield out

    return run


def similar_edges(fps: DataFrame, n: int, radius: int = NEAR_RADIUS, shard_limit: int = NEAR_LIMIT) -> DataFrame:
    """(a, b) over n distinct fingerprints fps(fp, f0, f1, ...), f being 64-bit words, whose components are those of all
    links within the radius. Every two fingerprints are compared, whatever the radius: they are dealt to parts, and each
    pair of parts, of ``NEAR_MOST`` fingerprints each, is one task's work. A pair returns stars, as a shard does."""
    words = [c for c in fps.columns if c != "fp"]
    parts = max(1, min(NEAR_PARTS, math.ceil(n / shard_limit)), math.ceil(n / NEAR_MOST))
    own = fps.withColumn("part", F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(parts)))
    to = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda j: F.least("part", j) * parts + F.greatest("part", j))
    pairs = own.select(F.explode(to).alias("pair"), "part", "fp", *words)
    dealt = pairs.repartition(parts * (parts + 1) // 2, "pair").sortWithinPartitions("pair", "part")
    return map_arrow(dealt, _pair_stars(radius, parts), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for each vertex of edges(a, b): the smallest vertex reachable. Alternating large and small stars,
    each round written to the shared folder."""
    e = edges.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w")).distinct()
    e = written(e, "stars")
    state = None
    while True:  # stars get flatter each round until none changes
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "w").cast("decimal(38,0)")).alias("h")).first()
        if now == state or not now["n"]:
            return e.select("v", F.col("w").alias("root"))
        state = now
        both = e.unionByName(e.select(F.col("w").alias("v"), F.col("v").alias("w")))
        low = both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("w > v").join(low, "v").select(F.col("w").alias("v"), F.col("m").alias("w"))
        large = large.unionByName(low.where("v != m").select("v", F.col("m").alias("w"))).distinct()
        low = large.groupBy("v").agg(F.min("w").alias("m"))
        small = large.join(low, "v").where("w != m").select(F.col("w").alias("v"), F.col("m").alias("w"))
        e = written(small.unionByName(low.select("v", F.col("m").alias("w"))).where("v != w").distinct(), "stars")


def wide_fingerprints(texts: list[str | None], shingle: int = NEAR_SHINGLE, words: int = NEAR_WORDS, step: int = 1 << 16) -> np.ndarray:
    """One row a text of ``words`` 64-bit words: majority bits over its shingles; A-Z lower-cased, ASCII white space."""
    out = np.zeros((len(texts), words), np.int64)
    for first, b in blocks(texts, NO_SPACE, 1 << 18):
        if not len(b.begin):
            continue
        n = np.bincount(b.of, minlength=b.texts)
        start = np.concatenate(([0], np.cumsum(n)[:-1]))
        many = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
        of = np.repeat(np.arange(b.texts), many)
        at = np.arange(len(of)) - np.repeat(np.concatenate(([0], np.cumsum(many)[:-1])), many) + start[of]
        h = np.append(b.hashes(lowered(b.raw)), np.zeros(shingle, np.uint64))
        end, ones = (start + n)[of], np.zeros((b.texts, 64 * words), np.int64)
        for lo in range(0, len(of), step):  # bounded memory for very long texts
            o, a, z = of[lo : lo + step], at[lo : lo + step], end[lo : lo + step]
            key = np.zeros(len(o), np.uint64)
            for j in range(shingle):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.where(a + j < z, h[a + j], np.uint64(j)))
            every = np.stack([mixed(key * np.uint64(2 * k + 3) + np.uint64(k)) for k in range(words)], axis=1)
            bits = np.unpackbits(every.astype(">u8").view(np.uint8).reshape(len(o), -1), axis=1)
            edge = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
            ones[o[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
        out[first : first + b.texts] = np.packbits(2 * ones > many[:, None], axis=1).view(">i8")
    return out


def _with_fingerprint(rows: DataFrame, text: str, near: bool, shingle: int) -> DataFrame:
    """rows, all columns, with ``_f0`` and so on, the words of the text's fingerprint."""
    at, words = rows.columns.index(text), NEAR_WORDS if near else 1
    names = [f"_f{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("simhash")
        for b in batches:
            texts = b.column(at).to_pylist()
            fps = wide_fingerprints(texts, shingle) if near else np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64)[:, None]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(np.ascontiguousarray(c)) for c in fps.T]], names=[*b.schema.names, *names])

    out = map_arrow(rows, run, T.StructType([*rows.schema.fields, *[T.StructField(n, T.LongType(), False) for n in names]]))
    return out.withColumn("_fp", F.xxhash64(*names) if near else F.col("_f0"))


def _linked(docs: DataFrame, key: str = "doc_id", near: bool = False, shingle: int | None = None, **options) -> DataFrame:
    """(key, fp, component_id, root) of every row; root, a fingerprint, tells components with equal ids apart."""
    own = _with_fingerprint(only(docs, key, "text"), "text", near, shingle or (NEAR_SHINGLE if near else SHINGLE)).drop("text")
    words = [c for c in own.columns if c.startswith("_f") and c != "_fp"]
    own = written(own.select(key, F.col("_fp").alias("fp"), *[F.col(w).alias(w[1:]) for w in words]), "simhash")
    words = [w[1:] for w in words]
    per = written(own.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n"), *[F.first(w).alias(w) for w in words]), "simhash-distinct")
    total, different = own.count(), per.count()
    edges = similar_edges(per.select("fp", *words), different, **options) if near else star_edges(per.select("fp"), **options)
    roots = components(edges)
    # Roots are fingerprints; a component's id is the smallest document id of all its fingerprints.
    of = per.join(roots, per["fp"] == roots["v"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    to = of.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = written(of.join(to, "root").select("fp", "n", "component_id", "root"), "simhash-components")
    # A fingerprint of many copies would meet in one task: there are at most 1,000 of these, so they are broadcast.
    many = F.col("n") > max(HOT_ROWS, total // 1000)
    hot, cold, own = linked.where(many).drop("n"), linked.where(~many).drop("n"), own.select(key, "fp")
    return own.join(F.broadcast(hot), "fp").unionByName(own.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(cold, "fp")).select(key, "fp", "component_id", "root")


def grouped(docs: DataFrame, key: str = "doc_id", near: bool = False, **options) -> DataFrame:
    """(key, fp, component_id) of every row. ``near``: links of wide fingerprints (``similar_edges``) instead of
    those that differ in a few of 64 bits."""
    return _linked(docs, key, near, **options).drop("root")


def one_of_each(docs: DataFrame, key: str = "doc_id", near: bool = True, shingle: int | None = None, **options) -> DataFrame:
    """docs with one row of each component: that of the smallest id, and of its repeated rows one.

    Rows with a null id stay only where their component has no other id. An id that several components share
    keeps a row of each; of several fingerprints of the smallest id in one component the least stays."""
    own = _linked(docs, key, near, shingle, **options).where(F.col(key).eqNullSafe(F.col("component_id")))
    first = own.groupBy("root", "fp").agg(F.first(key).alias("id"), F.count("*").alias("n")).groupBy("root").agg(F.min(F.struct("fp", "id", "n")).alias("x"))
    kept = written(first.select(F.col("x.fp").alias("_kept"), F.col("x.id").alias("_id"), F.col("x.n").alias("_n")), "simhash-kept")
    rows, (at, text) = by_place(docs, key, "text")
    names = rows.columns
    rows = _with_fingerprint(rows, text, near, shingle or (NEAR_SHINGLE if near else SHINGLE)).select(*names, "_fp")
    # Kept rows grow with the corpus, so they are never broadcast, at any size: each text moves once, dealt by its
    # fingerprint and id. Ids alone would join null or shared ids of other components.
    rows = rows.join(kept.hint("merge"), (rows["_fp"] == kept["_kept"]) & rows[at].eqNullSafe(kept["_id"]))
    once = rows.where("_n = 1").select(*names)
    again = rows.where("_n > 1").dropDuplicates([at, "_fp"]).select(*names)
    return once.unionByName(again).toDF(*docs.columns)
