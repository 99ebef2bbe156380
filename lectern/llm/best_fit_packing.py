"""Best-fit decreasing packing of token sequences into bins of a fixed capacity, over any number of documents.

Best-fit decreasing looks at lengths alone, so the plan is made from the histogram of piece lengths (at most
``capacity`` rows, on the driver): lengths go down, and all documents of a length are placed at once. A segment
tree over remaining capacities finds the tightest open bins; each takes as many of the length as fit, which is
what placing them one by one does. Bins alike are kept as ranges of numbers, so the plan's size depends on the
capacity, not on the corpus. Pieces then find their place by their rank among the pieces of their length; ranks
are counted in ``buckets`` even parts, so that no length is gathered in one task.

Defined cases: null or empty texts are one piece holding the end id alone; only longer documents are cut, the
last piece may be shorter; repeated rows are packed each; ties are broken by bucket and id, numbers of
sequences carry no meaning; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._shared import map_arrow, only, written

CAPACITY, END_ID, BUCKETS = 2048, 0, 4096


def pieces(docs: DataFrame, path: str, key: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, buckets: int = BUCKETS, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32, bucket[, ids]): each document's ids and the end id, cut at the capacity."""
    from .bpe_transducer import encoder

    d = only(docs, key, "text")
    long = lambda n: T.StructField(n, T.LongType(), False)
    fields = [d.schema[key], T.StructField("piece", T.IntegerType(), False), long("start"), long("length"), long("ids_crc32"), T.StructField("bucket", T.IntegerType(), False)]
    fields += [T.StructField("ids", T.ArrayType(T.LongType(), False), False)] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() * 1009  # rows are dealt in turn, whatever they hold
        for b in (whole.slice(k, 1000) for whole in batches for k in range(0, whole.num_rows, 1000)):
            texts = [t or "" for t in b.column(1).to_pylist()]
            row, cols, ids = [], [], []
            for i, x in enumerate(encoder(path).ids(texts)):
                x = np.append(x, np.uint32(end_id)).astype("<u4")
                for p in range(0, len(x), capacity):
                    cut = x[p : p + capacity]
                    row.append(i)
                    cols.append((p // capacity, p, len(cut), zlib.crc32(cut.tobytes()), at % buckets))
                    at += 1
                    if with_ids:
                        ids.append(cut.astype(np.int64))
            of = list(zip(*cols)) or [()] * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            arrays = [b.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, k) for c, k in zip(of, kinds)]]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.list_(pa.int64()))] * with_ids, names=[f.name for f in fields])

    return map_arrow(d, run, T.StructType(fields))


class _Tightest:
    """Segment tree over remaining capacities: which have open bins, and the smallest one from a length up."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = np.zeros(2 * self.leaves, bool)
        self.bins: dict[int, list[tuple[int, int]]] = {}

    def push(self, room: int, first: int, end: int) -> None:
        if first == end or room == 0:
            return
        self.bins.setdefault(room, []).append((first, end))
        i = room + self.leaves
        while i and not self.any[i]:
            self.any[i] = True
            i >>= 1

    def pop(self, room: int) -> tuple[int, int]:
        got = self.bins[room].pop()
        if not self.bins[room]:
            i = room + self.leaves
            self.any[i] = False
            while i > 1 and not self.any[i ^ 1]:
                i >>= 1
                self.any[i] = False
        return got

    def at_least(self, length: int) -> int | None:
        i = length + self.leaves
        if self.any[i]:
            return length
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, end rank, pieces a bin, first bin, offset), sorted by length and rank."""
    tree, bins, out = _Tightest(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.at_least(length)
            if room is None:
                room = capacity
                first, end = bins, bins + -(-left // (capacity // length))
                bins = end
            else:
                first, end = tree.pop(room)
            fit = room // length
            full = min(end - first, left // fit)
            for many, each in ((full, fit), (int(full < end - first and left > full * fit), left - full * fit)):
                if many:
                    out.append((length, rank, rank + many * each, each, first, capacity - room))
                    tree.push(room - each * length, first, first + many)
                    rank, left, first = rank + many * each, left - many * each, first + many
            tree.push(room, first, end)
    return np.array(sorted(out), np.int64).reshape(-1, 6)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut(length, bucket, ...) with sequence_id and offset added. cut has to be a written table: it is read twice."""
    per = cut.groupBy("length", "bucket").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most capacity rows
    rows = plan(histogram, capacity)
    shared = cut.sparkSession.sparkContext.broadcast(rows)
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = per.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("_base"))
    by = Window.partitionBy("bucket", "length").orderBy(*[c for c in cut.columns if c not in ("bucket", "length", "ids")])
    ranked = cut.withColumn("_rank", F.row_number().over(by) - 1).join(base, ["length", "bucket"])
    ranked = ranked.select(*cut.columns, (F.col("_base") + F.col("_rank")).alias("_rank"))
    kept = list(cut.columns)
    out = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType(), False), T.StructField("offset", T.LongType(), False)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            names = b.schema.names
            length = b.column(names.index("length")).to_numpy()
            rank = b.column(names.index("_rank")).to_numpy()
            lo, hi = np.searchsorted(p[:, 0], length, "left"), np.searchsorted(p[:, 0], length, "right")
            while (lo + 1 < hi).any():  # bisect every row's own stretch of the plan
                mid = (lo + hi) // 2
                right = (p[np.minimum(mid, len(p) - 1), 1] <= rank) & (lo + 1 < hi)
                lo, hi = np.where(right, mid, lo), np.where(right | (lo + 1 >= hi), hi, mid)
            _, first, _, each, bin_, offset = p[lo].T
            k = rank - first
            yield pa.RecordBatch.from_arrays([*[b.column(names.index(c)) for c in kept], pa.array(bin_ + k // each), pa.array(offset + k % each * length)], names=[*kept, "sequence_id", "offset"])

    return map_arrow(ranked, place, out)


def packed(docs: DataFrame, path: str, key: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of docs with sequence_id and offset. Pieces are written once, so no text is encoded twice."""
    return pack(written(pieces(docs, path, key, capacity, end_id, with_ids=with_ids), "pieces"), capacity).drop("bucket")
