"""Vector code compression: a codebook a part, made by Lloyd's rounds that Elkan's bounds spare most distances.

Components become integers (``floor(4096 * x)``), so sums and squared distances are exact whatever the order they are
added in. A row of the state is a block of vectors: components, each part's entry, an upper bound on the distance to
it (rounded up) and a lower bound on the distance to every entry of its codebook (rounded down). The state is persisted
from round to round. After a round the entries move; the upper bound grows by the own entry's movement, lower
bounds shrink by their entries'. An entry is passed over only if the triangle inequality says strictly that it is
farther (its lower bound, or half its distance from the own entry, above the upper bound); whoever is left is compared
by exact integer distance and number, so that ties fall to the lower number.

Only sums go to the driver: a number a component of an entry, whatever the table's size. A lost executor's blocks are
made again from the table, the rounds' codebooks being constants of the plan.

Defined cases: rows whose vector is null or holds null, NaN or infinite components are dropped. All kept vectors have
the length of the one of the smallest id, and that is a multiple of the number of parts: vectors of another length are
refused with an error that names it. Components beyond +-2**28 after scaling count as that, so that distances fit in 64
bits. Repeated rows are each encoded; where an id repeats, the codebook takes its smallest vector once; null ids come
last. Fewer ids than entries make smaller codebooks. Empty vectors have codes of zeros. Labels of any type, null among
them, may hold any share of rows. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import map_arrow, only, written

PARTS, ENTRIES, ROUNDS, SCALE, LIMIT, BLOCK = 8, 16, 6, 4096, 1 << 28, 4096
#: A label of more than this share of all rows is joined by broadcast: there are at most so many such labels.
HOT_LABELS = 1000


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) within the limit, as 64-bit integers."""
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int64)


def _above(x: np.ndarray) -> np.ndarray:
    """x as float32, never less."""
    y = x.astype(np.float32)
    return np.where(y < x, np.nextafter(y, np.float32(np.inf)), y)


def _below(x: np.ndarray) -> np.ndarray:
    """x as float16, never more."""
    y = np.minimum(x, 65_000).astype(np.float16)
    return np.where(y > x, np.nextafter(y, np.float16(-np.inf)), y)


def _root(squares: np.ndarray, up: bool) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + 1e-12 if up else 1 - 1e-12)


def movement(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each entry of books (part, entry, component) moved at most."""
    return _root(((new - old) ** 2).sum(2), True)


class Block:
    """Vectors (row, part, component), each part's entry, an upper bound on its distance and a lower bound an entry."""

    def __init__(self, vectors: np.ndarray, entries: int):
        n, parts = vectors.shape[:2]
        self.vectors, self.entry = vectors, np.zeros((n, parts), np.uint8)
        self.upper, self.lower = np.full((n, parts), np.inf, np.float32), np.zeros((n, parts, entries), np.float16)
        self.distances = 0

    def shift(self, moved: np.ndarray) -> None:
        """Keep the bounds true after entries moved."""
        own = np.take_along_axis(np.broadcast_to(moved, (len(self.entry), *moved.shape)), self.entry[:, :, None].astype(np.intp), 2)[:, :, 0]
        self.upper = _above(self.upper.astype(np.float64) + own)
        self.lower = np.maximum(_below(self.lower.astype(np.float64) - moved[None]), np.float16(0))

    def assign(self, books: np.ndarray) -> None:
        """Each part to the nearest entry, ties to the lower number."""
        for p in range(books.shape[0]):
            self._assign(p, books[p])

    def _assign(self, p: int, book: np.ndarray) -> None:
        x, a, low = self.vectors[:, p], self.entry[:, p].astype(np.intp), self.lower[:, p]
        half = _root(((book[:, None] - book[None]) ** 2).sum(2), False) / 2
        np.fill_diagonal(half, np.inf)
        up = self.upper[:, p].astype(np.float64)
        # A part that lies nearer its entry than half the way to any other needs no distance at all.
        rows = np.flatnonzero((half.min(1)[a] <= up) & (np.where(np.arange(len(book)) == a[:, None], np.inf, low).min(1) <= up) if len(book) > 1 else np.isinf(up))
        square = ((x[rows] - book[a[rows]]) ** 2).sum(1)
        self.distances += len(rows)
        near, mine = _root(square, True), a[rows]
        low[rows, mine] = _below(_root(square, False))
        for c in range(len(book)):
            ask = np.flatnonzero((mine != c) & (low[rows, c] <= near) & (half[mine, c] <= near))
            if not len(ask):
                continue
            there = ((x[rows[ask]] - book[c]) ** 2).sum(1)
            self.distances += len(ask)
            low[rows[ask], c] = _below(_root(there, False))
            nearer = (there < square[ask]) | (there == square[ask]) & (c < mine[ask])
            take = ask[nearer]
            mine[take], square[take] = c, there[nearer]
            near[take] = _root(square[take], True)
        self.entry[rows, p], self.upper[rows, p] = mine, _above(near)

    def sums(self, entries: int) -> np.ndarray:
        """Of each part and entry the number of its parts and their components' sums."""
        n, parts, width = self.vectors.shape
        out = np.zeros((parts, entries, width + 1), np.int64)
        for p in range(parts):
            np.add.at(out[p, :, 0], self.entry[:, p], 1)
            np.add.at(out[p, :, 1:], self.entry[:, p], self.vectors[:, p])
        return out

    def errors(self, books: np.ndarray) -> np.ndarray:
        """Of each vector the squared distance from its entries."""
        own = books[np.arange(books.shape[0])[None], self.entry]
        return ((self.vectors - own) ** 2).sum((1, 2))


def next_books(books: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Each entry by the floor of its parts' mean; one without parts stays."""
    count = sums[:, :, :1]
    return np.where(count > 0, sums[:, :, 1:] // np.maximum(count, 1), books)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


_STATE = "vectors binary, entry binary, upper binary, lower binary, sums array<bigint>"


def _state_row(b: Block, entries: int) -> list:
    small = b.vectors.astype(np.int16) if np.abs(b.vectors).max(initial=0) < 1 << 15 else b.vectors.astype(np.int32)
    return [small.tobytes(), b.entry.tobytes(), b.upper.tobytes(), b.lower.tobytes(), [b.distances, *b.sums(entries).ravel().tolist()]]


def _block(row: dict, n: int, books: np.ndarray) -> Block:
    parts, entries, width = books.shape
    size = len(row["vectors"]) // max(1, n * parts * width) if width else 4
    b = Block(np.frombuffer(row["vectors"], np.int16 if size == 2 else np.int32).reshape(n, parts, width).astype(np.int64), entries)
    b.entry = np.frombuffer(row["entry"], np.uint8).reshape(n, parts).copy()
    b.upper = np.frombuffer(row["upper"], np.float32).reshape(n, parts).copy()
    b.lower = np.frombuffer(row["lower"], np.float16).reshape(n, parts, entries).copy()
    return b


def _batches(batches: Iterator[pa.RecordBatch], out: pa.Schema, make) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            rows = make(b.slice(at, BLOCK))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=out)


def train(vectors: DataFrame, key: str, vector: str, label: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, int]:
    """((key, label, code, error) of every kept vector, final codebooks, distances computed)."""
    d = only(vectors, key, vector, label).toDF("id", "vector", "label")
    d = d.where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))))
    d = d.withColumn("vector", F.col("vector").cast("array<double>"))
    codes = T.StructType([d.schema["id"], d.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    ids = [r[0] for r in d.where("id IS NOT NULL").select("id").distinct().orderBy("id").limit(entries).collect()]
    first = d.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("vector").alias("vector")).orderBy("id").collect()
    first = first or d.orderBy("vector").limit(1).collect()  # ids that are all null give one entry
    if not first:
        return d.sparkSession.createDataFrame([], codes), np.zeros((parts, 0, 0), np.int64), 0
    long = len(first[0]["vector"])
    if long % parts or any(len(r["vector"]) != long for r in first):
        raise ValueError(f"vectors have to be of one length that is a multiple of {parts}; found {sorted({len(r['vector']) for r in first})}")
    books = integers(np.array([r["vector"] for r in first]).reshape(len(first), parts, long // parts)).transpose(1, 0, 2)
    k = books.shape[1]
    kept = T.StructType([T.StructField("ids", T.ArrayType(d.schema["id"].dataType)), T.StructField("labels", T.ArrayType(d.schema["label"].dataType))])
    for f in T._parse_datatype_string(_STATE).fields:
        kept.add(f)
    from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

    id_type, label_type = to_arrow_type(d.schema["id"].dataType), to_arrow_type(d.schema["label"].dataType)
    arrow = pa.schema([("ids", pa.list_(id_type)), ("labels", pa.list_(label_type)), ("vectors", pa.binary()), ("entry", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("sums", pa.list_(pa.int64()))])
    names = ("vectors", "entry", "upper", "lower", "sums")

    def begin(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
        def make(s: pa.RecordBatch) -> list:
            lists = s.column(1)
            bad = {n for n in np.diff(lists.offsets.to_numpy()).tolist() if n != long}
            if bad:
                raise ValueError(f"vectors of {sorted(bad)} components among those of {long}")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            b = Block(integers(flat).reshape(s.num_rows, parts, long // parts), k)
            b.assign(books)
            return [{"ids": s.column(0).to_pylist(), "labels": s.column(2).to_pylist(), **dict(zip(names, _state_row(b, k)))}]

        return _batches(batches, arrow, make)

    def again(books: np.ndarray, moved: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for r in rows.to_pylist():
                    b = _block(r, len(r["ids"]), books)
                    b.shift(moved)
                    b.assign(books)
                    yield pa.RecordBatch.from_pylist([{"ids": r["ids"], "labels": r["labels"], **dict(zip(names, _state_row(b, k)))}], schema=arrow)

        return run

    total, old, state = 0, None, map_arrow(d, begin, kept)
    for _ in range(rounds):
        state.persist(StorageLevel.MEMORY_AND_DISK)
        got = dict(state.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col")).collect())
        if old is not None:
            old.unpersist()
        total += got[0]
        sums = np.array([got[i + 1] for i in range(parts * k * (long // parts + 1))], np.int64).reshape(parts, k, -1)
        new = next_books(books, sums)
        old, state, books = state, map_arrow(state, again(new, movement(books, new)), kept), new

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for r in rows.to_pylist():
                b = _block(r, len(r["ids"]), books)
                code = [bytes(x).hex() for x in b.entry]
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], id_type), pa.array(r["labels"], label_type), pa.array(code), pa.array(b.errors(books))], names=["id", "label", "code", "error"])

    out = written(map_arrow(state, finish, codes), "codes")
    old.unpersist()
    return out, books, total


def encode(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **sizes: int) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every kept vector."""
    rows, books, _ = train(vectors, key, vector, label, **sizes)
    sums = written(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    # Labels of a thousandth of all rows or more are at most a thousand and go to the rows; the others meet by label.
    all_rows = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0][0]
    hot = F.col("n") * HOT_LABELS >= all_rows
    r, s = rows.alias("r"), sums.withColumnRenamed("label", "of")
    same = F.col("label").eqNullSafe(F.col("of"))
    first = r.join(F.broadcast(s.where(hot).drop("n")), same, "left").withColumn("met", F.col("label_error").isNotNull())
    rest = first.where(~F.col("met")).drop("of", "label_error", "met").join(s.where(~hot).drop("n").hint("merge"), same)
    both = first.where("met").select("id", "code", "error", "label_error").unionByName(rest.select("id", "code", "error", "label_error"))
    return both.withColumnRenamed("id", key).withColumn("codebooks_sha256", F.lit(digest(books)))
