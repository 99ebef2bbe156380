"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet in the corpus.

A slice of texts becomes two rows of tokens over one run of bytes. The ends of either row are counted a byte once
(``bincount``); bytes where both end cut the groups, bytes where either ends are the links (each stretch between two such
bytes lies in one token of either row, and two tokens share at most one). Running sums of the three marks, read at the
documents' own ends, give every document's figures.

A slice is written with its links as numbers of its own distinct (A id, B id) pairs. Corpus counts are one ``groupBy``
over slices' pairs; the highest count of a B id is a row an id of the vocabulary (32,000 at most) and goes to all.
Counts return to the slices that asked, packed.

Defined cases: a null or empty text, or one whose tokens do not spell a blank and the text, has no tokens and only zeros;
special strings are plain text; texts of any length are whole, the slice grows to hold one; repeated rows count each;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ._shared import kept_by, map_arrow, only, packed, written

SLICE, AT_ONCE = 1 << 20, 16
#: A run that might be one word of more than so many characters: merging by ranks takes its square.
RUN = re.compile(r"\S{2000}|\s{2000}")
BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Tokens:
    """Both tokenizers: ids of whole texts, and the bytes of every id.

    A byte-level file whose merges make tokens in the order of their ids is the same encoding by ranks, which
    ``tiktoken`` runs faster; texts with characters that its expressions may class by another Unicode table, and
    files of another kind, go to the library of the file."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        from .bpe_transducer import _RARE, _unicode_bytes

        self.rare, self.a, self.b = _RARE, Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        to_byte, vocab = _unicode_bytes(), self.a.get_vocab()
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            a_bytes[i] = bytes(to_byte[c] for c in t) if all(c in to_byte for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(m[1], 16)]) if (m := BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.bytes = (a_bytes, b_bytes)
        self.sizes = [np.array([len(x) for x in table], np.int64) for table in self.bytes]
        with open(a_path, encoding="utf-8") as f:
            whole = json.load(f)
        model, before = whole["model"], whole["pre_tokenizer"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        ranked = before["type"] == "ByteLevel" and not before.get("add_prefix_space") and not whole["normalizer"] and not model.get("end_of_word_suffix") and made == sorted(made)
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        ranks = {a_bytes[i]: i for t, i in vocab.items() if t not in special}
        self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranked else None
        gc.collect()  # what the file was read into

    def ids(self, texts: list[str]) -> tuple[list, list]:
        """Of each text A's ids, with a blank before it, and B's, which adds the blank itself."""
        slow = [i for i, t in enumerate(texts) if self.ranked is None or self.rare.search(t) or RUN.search(t)]
        by_library = dict(zip(slow, self.a.encode_batch_fast([" " + texts[i] for i in slow], add_special_tokens=False)))
        a = [by_library[i].ids if i in by_library else self.ranked.encode_ordinary(" " + t) for i, t in enumerate(texts)]
        return a, self.b.encode(texts, num_threads=1)


class Aligned:
    """The tokens of some texts over one run of bytes; ``ends`` are the texts' ends in it."""

    def __init__(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], ends: np.ndarray):
        self.ids, last, total = (a[0], b[0]), (np.cumsum(a[1]), np.cumsum(b[1])), int(ends[-1]) if len(ends) else 0
        mark = [np.bincount(e, minlength=total + 1).astype(bool) for e in last]
        both, either = mark[0] & mark[1], mark[0] | mark[1]
        self.cut = np.cumsum(both, dtype=np.int32)
        so_far = [np.cumsum(m, dtype=np.int32) for m in mark]
        place = np.flatnonzero(either)
        self.link = [ids[(s - m)[place]] for ids, s, m in zip(self.ids, so_far, mark)]
        self.group = [self.cut[e] - both[e] for e in last]
        of = lambda sums: np.diff(sums[ends], prepend=0).astype(np.int64)
        self.n = [of(s) for s in so_far]
        self.n_groups, self.n_links = of(self.cut), of(np.cumsum(either, dtype=np.int32))

    def spelled_out(self) -> tuple[np.ndarray, np.ndarray]:
        """The groups of all texts as ``a1,a2|b1;a3|b2,b3;`` in bytes, and each text's length in it."""
        groups = int(self.cut[-1]) if len(self.cut) else 0
        many = [np.bincount(g, minlength=groups) for g in self.group]
        before = [np.cumsum(m) - m for m in many]
        at = (np.arange(len(self.ids[0])) + before[1][self.group[0]], np.arange(len(self.ids[1])) + (before[0] + many[0])[self.group[1]])
        ids, sign = np.empty(sum(map(len, at)), np.int64), np.full(sum(map(len, at)), ord(","), np.uint8)
        for place, i in zip(at, self.ids):
            ids[place] = i
        for k, mark in enumerate("|;"):
            final = np.flatnonzero(np.diff(self.group[k], append=groups))
            sign[at[k][final]] = ord(mark)
        digits, length = _decimals()
        out = digits[ids]
        out[np.arange(len(ids)), length[ids]] = sign
        size = np.cumsum(length[ids] + 1)
        tokens = np.cumsum(self.n[0] + self.n[1])
        ends = np.concatenate(([0], size))[tokens]
        return out[np.arange(6)[None] <= length[ids][:, None]], np.diff(ends, prepend=0)


_table: list[np.ndarray] = []


def _decimals() -> tuple[np.ndarray, np.ndarray]:
    """The digits of every id below 100,000, and their number."""
    if not _table:
        n = np.arange(100_000)
        length = 1 + sum((n >= 10**k).astype(np.int64) for k in range(1, 5))
        digits = np.zeros((len(n), 6), np.uint8)
        for k in range(5):
            has = length > k
            digits[has, k] = 48 + n[has] // 10 ** (length[has] - 1 - k) % 10
        _table.extend((digits, length))
    return _table[0], _table[1]


def aligned(texts: list[str | None], tokens: Tokens) -> Aligned:
    """All texts at once; those without tokens have zeros."""
    at, size = [i for i, t in enumerate(texts) if t], np.zeros(len(texts), np.int64)
    flat: tuple[list, list] = ([], [])
    for few in range(0, len(at), AT_ONCE):  # lists of ids are many times their arrays
        some = at[few : few + AT_ONCE]
        for i, *ids in zip(some, *tokens.ids([texts[i] for i in some])):
            raw = (" " + texts[i]).encode("utf-8", "surrogatepass")
            if all(b"".join([table[x] for x in own]) == raw for own, table in zip(ids, tokens.bytes)):
                size[i] = len(raw)
                for held, own in zip(flat, ids):
                    held.append(np.array(own, np.int32))
    a, b = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in flat)
    return Aligned((a, tokens.sizes[0][a]), (b, tokens.sizes[1][b]), np.cumsum(size))


def _pack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a << 20 | b


def _slices(docs: DataFrame, key: str, a_path: str, b_path: str, most: int) -> DataFrame:
    """Written: a row a slice with its documents' figures, its distinct pairs, their numbers and the links."""
    id_type = docs.schema[key].dataType
    names = ("n_a", "n_b", "n_groups", "n_links")
    arrow = pa.schema([("block", pa.int64()), ("ids", pa.list_(to_arrow_type(id_type))), *[(n, pa.list_(pa.int64())) for n in names], ("sha", pa.list_(pa.string())), ("pairs", pa.binary()), ("pair_n", pa.binary()), ("links", pa.binary())])
    lists = [T.StructField(n, T.ArrayType(t)) for n, t in (("ids", id_type), *((n, T.LongType()) for n in names), ("sha", T.StringType()))]
    schema = T.StructType([T.StructField("block", T.LongType()), *lists, *[T.StructField(n, T.BinaryType()) for n in ("pairs", "pair_n", "links")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = kept_by("alignment")
        if (a_path, b_path) not in held:
            held[a_path, b_path] = Tokens(a_path, b_path)
        tokens, number = held[a_path, b_path], TaskContext.get().partitionId() << 32
        for b in batches:
            at, size = 0, np.concatenate(([0], np.cumsum(pc.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False))))
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(size, size[at] + most, side="right")) - 1)
                s = b.slice(at, to - at)
                x = aligned(s.column(1).to_pylist(), tokens)
                text, length = x.spelled_out()
                raw, edge = text.tobytes(), np.concatenate(([0], np.cumsum(length))).tolist()
                sha = [hashlib.sha256(raw[p : q - 1]).hexdigest() if q > p else "" for p, q in zip(edge, edge[1:])]
                pairs, back, n = np.unique(_pack(*x.link), return_inverse=True, return_counts=True)
                by = np.argsort(-n, kind="stable")  # common pairs get small numbers, which compress
                rank = np.empty(len(by), np.uint32)
                rank[by] = np.arange(len(by))
                links = rank[back].astype(np.uint16 if len(by) < 1 << 16 else np.uint32)
                row = {"block": number, "ids": s.column(0).to_pylist(), "n_a": x.n[0].tolist(), "n_b": x.n[1].tolist(), "n_groups": x.n_groups.tolist(), "n_links": x.n_links.tolist(), "sha": sha, "pairs": pairs[by].tobytes(), "pair_n": n[by].tobytes(), "links": links.tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=arrow)
                at, number = to, number + 1

    return written(map_arrow(docs, run, schema), "alignment")


def pair_counts(slices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((block, item), (item, n)): the pairs a slice holds, and their numbers of links in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, pairs, n in zip(*(c.to_pylist() for c in b.columns)):
                pairs, n = np.frombuffer(pairs, np.int64), np.frombuffer(n, np.int64)
                for at in range(0, len(n), 1 << 16):
                    cut = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n[cut]), block)), pa.array(pairs[cut]), pa.array(n[cut])], names=["block", "item", "n"])

    rows = map_arrow(slices.select("block", "pairs", "pair_n"), run, "block long, item long, n long")
    return rows.select("block", "item"), rows.groupBy("item").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", most: int = SLICE) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs(key, text)."""
    slices = _slices(only(docs, key, "text"), key, a_path, b_path, most)
    asked, counts = pair_counts(slices)
    counts = written(counts, "pair-counts")
    highest = counts.groupBy(F.col("item").bitwiseAND((1 << 20) - 1).alias("b")).agg(F.max("n").alias("most"))
    told = counts.join(F.broadcast(highest), F.col("item").bitwiseAND((1 << 20) - 1) == F.col("b")).select("item", (F.col("n") * 2 + (F.col("n") == F.col("most")).cast("long")).alias("value"))
    answers = packed(asked.join(told, "item").select("block", "item", "value"), False).withColumn("kind", F.lit(0))
    figures = slices.withColumn("kind", F.lit(1)).drop("pair_n")
    rows = answers.unionByName(figures, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")
    rows = rows.select("block", "kind", "items", "value", *[c for c in figures.columns if c not in ("block", "kind")])
    names = [key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    id_type = to_arrow_type(docs.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, []
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(k)[i].as_py() for k, c in enumerate(b.schema.names)}
                if row["block"] != now:
                    now, found = row["block"], []
                if row["kind"] == 0:
                    found.append((np.frombuffer(row["items"], np.int64), np.frombuffer(row["value"], np.int64)))
                    continue
                ends = np.concatenate(([0], np.cumsum(row["n_links"]))).astype(np.int64)
                best = total = np.zeros(len(ends), np.int64)
                if found:
                    item, value = (np.concatenate(x) for x in zip(*found))
                    by = np.argsort(item)
                    pairs = np.frombuffer(row["pairs"], np.int64)
                    links = np.frombuffer(row["links"], np.uint16 if len(pairs) < 1 << 16 else np.uint32)
                    own = value[by][np.searchsorted(item[by], pairs)][links]
                    best, total = (np.concatenate(([0], np.cumsum(x)))[ends] for x in (own & 1, own >> 1))
                    found = []
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], id_type), *[pa.array(row[n], pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")], pa.array(np.diff(best)), pa.array(np.diff(total)), pa.array(row["sha"])], names=names)

    schema = T.StructType([docs.schema[key], *[T.StructField(n, T.LongType()) for n in names[1:-1]], T.StructField(names[-1], T.StringType())])
    return map_arrow(rows, run, schema)
