"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each with a context tree of its own over the preceding ``depth`` bytes. Every context
keeps a Krichevsky-Trofimov estimate of its decision; a text's probability mixes the estimates of all depths, each
context giving half to its own and half to the product of its longer contexts' (Willems, Shtarkov, Tjalkens). What is
learned are counts of (context, byte) over all learned rows; a prediction is the exact ratio of weighted
probabilities with and without the new byte, so unseen contexts predict even odds and all bytes together add up to one.

A (context, byte) pair is a *gram*: one 64-bit number, the most recent byte first. Work is cut so that no task holds what
grows with the corpus:

* rows are packed into blocks of about ``block`` bytes of one part; a block knows its distinct grams and words;
* counts are one ``groupBy`` over blocks' grams, so a gram that stands in every text is one row a block;
* subtrees below the last ``ROOT`` bytes are dealt by those bytes (at most 256 ** (depth - ROOT + 1) grams each) and
  computed in arrays, leaves first; the levels above are joins and sums of rows (context, decision);
* predictions go back to the blocks that asked for them, packed, and stand before the block's texts in its task.

The base score is a unigram of words with one added to every count.

Defined cases: a null or empty text is its end alone; texts of any length are read whole, in stretches; repeated rows
are learned and scored each; a null id counts as the empty text where rows are dealt by id; without learned rows
every decision has even odds, and the base score divides by one; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ._shared import map_arrow, only, packed, written
from .text_arrays import ODD

DEPTH, ROOT, BLOCK, SLICE, STRETCH, GROUP = 5, 3, 1 << 25, 1 << 20, 1 << 19, 1 << 19
#: Stands before a text and after it; no UTF-8 text holds this byte.
EDGE, END = b"\xff", b" "
HALF = float(np.log(0.5))


def log_gamma(x, log=np.log):
    """By Stirling's series eight steps on; x is an array, or a column with log=F.log."""
    z = x + 8.0
    return (z - 0.5) * log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7))


def log_kt(zeros, ones, log=np.log):
    """Log probability that the estimator gives to so many zeros and ones in any order."""
    return log_gamma(zeros + 0.5, log) + log_gamma(ones + 0.5, log) - log_gamma(zeros + ones + 1.0, log) - 1.1447298858494002


def grams(text: np.ndarray, begin: np.ndarray, size: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(gram, text's number) of the positions begin .. begin + size of each text, in stretches; ``depth`` edges stand
    before each text."""
    stop = np.concatenate(([0], begin + size))
    for low in range(depth, len(text), STRETCH):
        high = min(low + STRETCH, len(text))
        part = text[low - depth : high].astype(np.int64)
        g = np.zeros(high - low, np.int64)
        for i in range(1, depth + 1):
            g = g << 8 | part[depth - i : len(part) - i]
        g = g << 8 | part[depth:]
        first, last = np.searchsorted(stop, (low, high - 1), side="right") - 1
        of = np.repeat(np.arange(first, last + 1), np.minimum(stop[first + 1 : last + 2], high) - np.maximum(stop[first : last + 1], low))
        real = np.arange(low, high) >= begin[of]
        yield g[real], of[real]


class Lookup:
    """The value of each key by hash: whoever finds its place taken goes to the next, smaller table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.tables = keys, values, []
        rest = np.arange(len(keys), dtype=np.int32)
        while len(rest):
            bits = len(rest).bit_length() + 1
            factor, table = np.uint64(ODD * (2 * len(self.tables) + 1) % (1 << 64)), np.zeros(1 << bits, np.int32)
            slot = self._slot(keys[rest], factor, bits)
            table[slot] = rest
            self.tables.append((factor, bits, table))
            rest = rest[table[slot] != rest]

    @staticmethod
    def _slot(keys: np.ndarray, factor: np.uint64, bits: int) -> np.ndarray:
        return (keys.view(np.uint64) * factor >> np.uint64(64 - bits)).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that are all known."""
        factor, bits, table = self.tables[0]
        at = table[self._slot(keys, factor, bits)]
        for factor, bits, table in self.tables[1:]:
            gone = np.flatnonzero(self.keys[at] != keys)
            if not len(gone):
                break
            at[gone] = table[self._slot(keys[gone], factor, bits)]
        return self.values[at]


def joined(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other, each between edges, and where each one's bytes and end stand."""
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    raw = np.frombuffer(b"".join(x for t in texts for x in (EDGE * depth, t, EDGE)), np.uint8)
    return raw, np.cumsum(size + depth) - size, size


def counted(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct g in order with their sums of n."""
    by = np.argsort(g, kind="stable")
    g, n = g[by], n[by]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(g)), bool), g[1:] != g[:-1])))
    return g[first], np.add.reduceat(n, first) if len(first) else n


class Held:
    """What a block has seen: distinct grams and words, each with its number in learned texts."""

    def __init__(self, depth: int):
        self.depth, self.parts, self.words, self.bytes = depth, [], Counter(), 0

    def add(self, texts: list[bytes], learn: np.ndarray) -> None:
        for g, of in grams(*joined(texts, self.depth), self.depth):
            s = np.sort(g << 1 | learn[of])
            first = np.flatnonzero(np.concatenate(([True], s[1:] >> 1 != s[:-1] >> 1)))
            self.parts.append((s[first] >> 1, np.add.reduceat(s & 1, first)))
        if len(self.parts) > 16:
            self.parts = [self.grams()]
        for t, yes in zip(texts, learn.tolist()):
            if yes:
                self.words.update(t.split())
            else:
                self.words.update(dict.fromkeys(t.split(), 0))
        self.words[END] += int(learn.sum())
        self.bytes += sum(map(len, texts))

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        return counted(np.concatenate([g for g, _ in self.parts]), np.concatenate([n for _, n in self.parts]))


class Level:
    """Contexts of one length: of each of the eight decisions its nodes' prefix (context and the byte's bits so far),
    numbers of zeros and ones, and the node of each gram."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        self.key, self.prefix, self.of, self.zeros, self.ones = key, [], [], [], []
        self.parent: list[np.ndarray] = []
        for j in range(8):
            p = key >> (8 - j)
            new = np.concatenate((np.ones(min(1, len(p)), bool), p[1:] != p[:-1]))
            self.of.append(np.cumsum(new) - 1)
            self.prefix.append(p[new])
            one, nodes = (key >> (7 - j)) & 1, int(new.sum())
            self.ones.append(np.bincount(self.of[j], n * one, nodes))
            self.zeros.append(np.bincount(self.of[j], n * (1 - one), nodes))


def shorter(key: np.ndarray, bits: int) -> np.ndarray:
    """key without the oldest byte of its context, which stands over the last ``bits`` bits."""
    return (key >> (8 + bits) << bits) | (key & ((1 << bits) - 1))


class Subtree:
    """All contexts of ``depth`` down to ``root`` bytes over some grams, with weighted probabilities."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, depth: int, root: int):
        self.levels = [Level(gram, n)]
        for _ in range(depth - root):
            self.levels.append(Level(*counted(shorter(self.levels[-1].key, 8), self._sums())))
        self.log: list[list[np.ndarray]] = []
        for i, level in enumerate(self.levels):
            self.log.append([])
            for j in range(8):
                kt = log_kt(level.zeros[j], level.ones[j])
                if i:
                    below = self.levels[i - 1]
                    below.parent.append(np.searchsorted(level.prefix[j], shorter(below.prefix[j], j)))
                    kt = HALF + np.logaddexp(kt, np.bincount(below.parent[j], self.log[i - 1][j], len(kt)))
                self.log[i].append(kt)

    def _sums(self) -> np.ndarray:
        """Of each gram of the last level its count: what its last decision saw."""
        last = self.levels[-1]
        return np.where(last.key & 1, last.ones[7][last.of[7]], last.zeros[7][last.of[7]]).astype(np.int64)

    def roots(self) -> tuple[np.ndarray, ...]:
        """(context and node number, zeros, ones, log weighted probability) of the shortest contexts."""
        top, log = self.levels[-1], self.log[-1]
        number = [(p >> j << 8) | (1 << j) | (p & ((1 << j) - 1)) for j, p in enumerate(top.prefix)]
        return tuple(map(np.concatenate, (number, top.zeros, top.ones, log)))

    def scores(self, above: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log10 of each gram's prediction. above: what shorter contexts give to a one, rest: the weight they leave,
        both in the order of ``roots``."""
        size = np.cumsum([0] + [len(p) for p in self.levels[-1].prefix])
        p, left = [above[a:z] for a, z in zip(size, size[1:])], [rest[a:z] for a, z in zip(size, size[1:])]
        for i in range(len(self.levels) - 1, -1, -1):
            level = self.levels[i]
            for j in range(8):
                own = 1.0
                if i:
                    own = np.exp(np.minimum(0, HALF + log_kt(level.zeros[j], level.ones[j]) - self.log[i][j]))
                p[j] = p[j] + left[j] * own * (level.ones[j] + 0.5) / (level.zeros[j] + level.ones[j] + 1)
                left[j] = left[j] * (1 - own)
                if i:
                    parent = self.levels[i - 1].parent[j]
                    p[j], left[j] = p[j][parent], left[j][parent]
        level, out = self.levels[0], np.zeros(len(self.levels[0].key))
        for j in range(8):
            one = p[j][level.of[j]]
            out += np.log10(np.where((level.key >> (7 - j)) & 1, one, 1 - one))
        return out


def _blocks(docs: DataFrame, key: str, depth: int, block: int) -> DataFrame:
    """Written: per block rows of texts (ids, learn, ends, text) and one of what it holds (grams, words, counts)."""
    id_type = docs.schema[key].dataType
    arrow = pa.schema([("block", pa.int64()), ("ids", pa.list_(to_arrow_type(id_type))), ("learn", pa.list_(pa.bool_())), ("ends", pa.list_(pa.int64())), ("text", pa.binary()), ("grams", pa.binary()), ("gram_n", pa.binary()), ("words", pa.binary()), ("word_n", pa.binary())])
    held = [T.StructField(n, T.BinaryType()) for n in ("text", "grams", "gram_n", "words", "word_n")]
    schema = T.StructType([T.StructField("block", T.LongType()), *[T.StructField(n, T.ArrayType(t)) for n, t in (("ids", id_type), ("learn", T.BooleanType()), ("ends", T.LongType()))], *held])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        squeeze = zstandard.ZstdCompressor(level=1).compress
        number, held = TaskContext.get().partitionId() << 32, Held(depth)

        def all_of() -> pa.RecordBatch:
            g, n = held.grams()
            found = {"block": number, "grams": g.tobytes(), "gram_n": n.tobytes(), "words": b"\n".join(held.words), "word_n": np.fromiter(held.words.values(), np.int64, len(held.words)).tobytes()}
            return pa.RecordBatch.from_pylist([found], schema=arrow)

        for b in batches:
            at, size = 0, np.concatenate(([0], np.cumsum(pc.binary_length(b.column(1)).fill_null(0).to_numpy())))
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(size, size[at] + SLICE, side="right")) - 1)
                s = b.slice(at, to - at)
                texts = [(t or b"").lower() for t in s.column(1).to_pylist()]
                learn = np.array(s.column(2).to_pylist(), np.int64)
                held.add(texts, learn)
                ends = np.cumsum([len(t) for t in texts])
                yield pa.RecordBatch.from_pylist([{"block": number, "ids": s.column(0).to_pylist(), "learn": learn.astype(bool).tolist(), "ends": ends.tolist(), "text": squeeze(b"".join(texts))}], schema=arrow)
                at = to
                if held.bytes >= block:
                    yield all_of()
                    number, held = number + 1, Held(depth)
        if held.parts:
            yield all_of()

    return written(map_arrow(docs, run, schema), "lm-blocks")


def _unpacked(blocks: DataFrame, what: str) -> DataFrame:
    """(block, item, n): a row for each gram or word that a block holds."""
    words = what == "words"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, items, n in zip(*(c.to_pylist() for c in b.columns)):
                n = np.frombuffer(n, np.int64)
                items = pa.array(items.split(b"\n"), pa.binary()) if words else pa.array(np.frombuffer(items, np.int64))
                for at in range(0, len(n), 1 << 16):
                    cut = items.slice(at, 1 << 16)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), block)), cut, pa.array(n[at : at + len(cut)])], names=["block", "item", "n"])

    held = blocks.where(F.col(what).isNotNull()).select("block", what, "word_n" if words else "gram_n")
    return map_arrow(held, run, f"block long, item {'binary' if words else 'long'}, n long")


def _shorter(node: Column) -> Column:
    """The node of the next shorter context."""
    return F.shiftleft(F.shiftright(node, 16), 8).bitwiseOR(node.bitwiseAND(255))


def _log_sum(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def predictions(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(item, value): of every row of counts(item, n), distinct grams, the log10 of its prediction."""
    root = min(ROOT, depth)
    counts = written(counts, "lm-counts")
    parts = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // GROUP))
    deal = lambda c: F.pmod(F.xxhash64(c), parts)
    own = counts.withColumn("part", deal(F.shiftright("item", 8 * (depth - root + 1))))

    def ordered(t: pa.Table) -> Subtree:
        g, n = t.column("item").to_numpy(), t.column("n").to_numpy()
        by = np.argsort(g)
        return Subtree(g[by], n[by], depth, root)

    def up(t: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("node", "zeros", "ones", "log"), map(pa.array, ordered(t).roots()))))

    def down(t: pa.Table, above: pa.Table) -> pa.Table:
        tree = ordered(t)
        by = np.argsort(above.column("node").to_numpy())
        at = by[np.searchsorted(above.column("node").to_numpy()[by], tree.roots()[0])]
        value = tree.scores(above.column("p").to_numpy()[at], above.column("rest").to_numpy()[at])
        return pa.table({"item": tree.levels[0].key, "value": value})

    map_arrow(own.limit(0), lambda x: x, own.schema)  # gives this package's code to the executors
    levels = [written(own.groupBy("part").applyInArrow(up, "node long, zeros double, ones double, log double"), "lm-nodes")]
    for _ in range(root):
        kids = levels[-1].groupBy(_shorter(F.col("node")).alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log").alias("below"))
        kt = log_kt(F.col("zeros"), F.col("ones"), F.log)
        levels.append(written(kids.select("node", "zeros", "ones", (_log_sum(kt, F.col("below")) + HALF).alias("log")), "lm-nodes"))
    above = levels[-1].select("node", F.lit(0.0).alias("p"), F.lit(1.0).alias("rest"))
    for bytes_, level in zip(range(root), levels[:0:-1]):  # from the empty context on
        weight = F.exp(F.least(F.lit(0.0), log_kt(F.col("zeros"), F.col("ones"), F.log) + HALF - F.col("log")))
        one = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
        mixed = level.join(above, "node").select(F.col("node").alias("up"), (F.col("p") + F.col("rest") * weight * one).alias("p"), (F.col("rest") * (1 - weight)).alias("rest"))
        # Contexts of no byte and of one byte are at most 255 and 65,280 rows, whatever the corpus.
        mixed = F.broadcast(mixed) if bytes_ < 2 else mixed
        above = levels[root - bytes_ - 1].select("node", _shorter(F.col("node")).alias("up")).join(mixed, "up").select("node", "p", "rest")
    above = above.withColumn("part", deal(F.shiftright("node", 8)))
    return own.groupBy("part").cogroup(above.groupBy("part")).applyInArrow(down, "item long, value double")


def score_documents(docs: DataFrame, learn: Column, key: str = "doc_id", depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """(key, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row of docs(key, text), learned
    from those that ``learn``, a condition on the key, names. Scores are log10 probabilities."""
    d = only(docs, key, "text").select(key, F.col("text").cast("binary").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    blocks = _blocks(d, key, depth, block)
    words = _unpacked(blocks, "words")
    counts = written(words.groupBy("item").agg(F.sum("n").alias("value")), "lm-words")
    total, distinct = counts.agg(F.coalesce(F.sum("value"), F.lit(0)), F.count_if(F.col("value") > 0)).collect()[0]
    grams_ = _unpacked(blocks, "grams")
    told = predictions(grams_.groupBy("item").agg(F.sum("n").alias("n")), depth)
    none = F.lit(None)
    answers = packed(words.select("block", "item").join(counts, "item").select("block", "item", "value"), True).withColumn("kind", F.lit(0))
    answers = answers.unionByName(packed(grams_.select("block", "item").join(told, "item").select("block", "item", F.col("value").cast("float").alias("value")), False).withColumn("kind", F.lit(1)))
    texts = blocks.where("text IS NOT NULL").select("block", F.lit(2).alias("kind"), none.cast("binary").alias("items"), none.cast("binary").alias("value"), "ids", "learn", "ends", "text")
    for c in ("ids", "learn", "ends", "text"):
        answers = answers.withColumn(c, none.cast(texts.schema[c].dataType))
    rows = texts.unionByName(answers).repartition("block").sortWithinPartitions("block", "kind")
    id_type = to_arrow_type(docs.schema[key].dataType)
    names = [key, "held_out", "n_bytes", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        now, known, found, value = None, {}, [], None
        for b in batches:
            kinds, blocks_ = b.column(1).to_pylist(), b.column(0).to_pylist()
            for i, (block, kind) in enumerate(zip(blocks_, kinds)):
                if block != now:
                    now, known, found, value = block, {}, [], None
                row = {c: b.column(k)[i].as_py() for k, c in enumerate(b.schema.names) if k > 1}
                if kind == 0:
                    known.update(zip(row["items"].split(b"\n"), np.frombuffer(row["value"], np.int64).tolist()))
                    continue
                if kind == 1:
                    found.append((np.frombuffer(row["items"], np.int64), np.frombuffer(row["value"], np.float32)))
                    continue
                if value is None:
                    value, found = Lookup(*(np.concatenate(x) for x in zip(*found))), []
                edge = [0, *row["ends"]]
                text = zstandard.decompress(row["text"])
                texts = [text[a:z] for a, z in zip(edge, edge[1:])]
                score = np.zeros(len(texts))
                for g, of in grams(*joined(texts, depth), depth):
                    score += np.bincount(of, value(g), len(texts))
                many, seen, base = [], [], []
                for t in texts:
                    c = np.fromiter(map(known.__getitem__, (*t.split(), END)), np.int64)
                    many.append(len(c))
                    seen.append(int((c > 0).sum()))
                    base.append(float(np.log10((c + 1) / (total + distinct + 1)).sum()))
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], id_type), pa.array([not x for x in row["learn"]]), pa.array(np.diff(edge)), pa.array(many, pa.int64()), pa.array(seen, pa.int64()), pa.array([total] * len(many), pa.int64()), pa.array(base, pa.float64()), pa.array(score)], names=names)

    schema = T.StructType([docs.schema[key], T.StructField("held_out", T.BooleanType())])
    for n in names[2:]:
        schema.add(n, "double" if n.endswith("score") else "long")
    return map_arrow(rows, run, schema).withColumn("bits_per_byte", -F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1))
