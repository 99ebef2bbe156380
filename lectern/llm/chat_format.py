"""Chat formatting as a prefix tree: conversations that share initial turns share their tokens.

A turn's node is the hash of its whole prefix, so equal prefixes are equal nodes whoever holds them.
Conversations sorted by their chains of hashes visit the tree depth first; each emits the turns beyond what it
shares with the one before it. Output comes in blocks, each a training sequence of its own: the tokens and the
text in depth-first order, and for each node its tokens' place, the position id of their first (positions go on from
the parent's last), the intervals of its ancestors' tokens that it attends to, and the tokens under the loss mask (an
assistant's text); the places of node and mask in the text beside. A turn's marks and its text are tokenised apart, so
that equal turns are equal tokens and the mask ends where a token ends. A block closes at about ``block_chars``; what a subtree shares with the block before is emitted again once at the
head of the next, so no task holds a whole tree, however many conversations start alike.

The template marks a turn as ``<s>[INST] text [/INST]`` (user), ``<s><<SYS>> text <</SYS>>`` (system), ``text
</s>`` (assistant) or ``<s>[ROLE]role[/ROLE] text [/TURN]``. Control strings inside texts get a backslash after
their first character, backslashes are doubled; ``unescaped`` takes both back.

Defined cases: null text is empty, a null role is the empty role; a null id is one conversation; turns are
ordered by turn (nulls first), then role and text; repeated rows are turns of their own; extra columns are
ignored; an empty table gives no block but those of conversations given beside it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import map_arrow, only, written
from .bpe_transducer import encoder

BLOCK_CHARS = 1 << 18
_CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]")
_INSIDE = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in _CONTROL))
_MARKED = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\]|<s><<SYS>> (.*?) <</SYS>>|<s>\[ROLE\](.*?)\[/ROLE\] (.*?) \[/TURN\]|(.*?) </s>", re.S)

#: Places in the block's text, in its tokens, the first token's position id, the parent's number (-1: none).
_PLACES = ("begin", "end", "loss_begin", "loss_end", "token_begin", "token_end", "loss_token_begin", "loss_token_end", "position", "parent")
NODE = T.StructType([T.StructField(n, T.LongType()) for n in _PLACES] + [T.StructField("ancestors", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])))])


def escaped(text: str) -> str:
    return _INSIDE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescaped(text: str) -> str:
    return _MARKED.sub(r"\1", text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, where its loss begins and ends in it)."""
    e = escaped(text)
    if role == "user":
        return f"<s>[INST] {e} [/INST]", 0, 0
    if role == "system":
        return f"<s><<SYS>> {e} <</SYS>>", 0, 0
    if role == "assistant":
        return f"{e} </s>", 0, len(e)
    return f"<s>[ROLE]{escaped(role)}[/ROLE] {e} [/TURN]", 0, 0


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation, read back."""
    out = []
    for m in _TURN.finditer(formatted):
        user, system, role, other, assistant = m.groups()
        if user is not None:
            out.append(("user", unescaped(user)))
        elif system is not None:
            out.append(("system", unescaped(system)))
        elif other is not None:
            out.append((unescaped(role), unescaped(other)))
        else:
            out.append(("assistant", unescaped(assistant)))
    return out


def chains(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, roles, texts, chain): each conversation's turns in order, and the hash of each prefix."""
    d = only(rows, key, "turn", "role", "text").select(key, "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    per = d.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    per = per.select(key, F.transform("t", lambda x: x["role"]).alias("roles"), F.transform("t", lambda x: x["text"]).alias("texts"))
    schema = T.StructType([*per.schema.fields, T.StructField("chain", T.ArrayType(T.BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for roles, texts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                h, own = b"", []
                for r, t in zip(roles, texts):
                    r, t = r.encode("utf-8", "surrogatepass"), t.encode("utf-8", "surrogatepass")
                    h = hashlib.blake2b(h + len(r).to_bytes(8, "big") + r + t, digest_size=16).digest()
                    own.append(h)
                out.append(own)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.binary()))], names=[*b.schema.names, "chain"])

    return map_arrow(per, run, schema)


class _Block:
    """One block under way: its text, nodes, the open path from the root, and where its conversations end. Tokens are
    made when it closes, those of all its turns at once."""

    def __init__(self):
        self.parts, self.size, self.pieces, self.nodes, self.path, self.ends = [], 0, [], [], [], []

    def add(self, key, roles, texts, chain) -> None:
        shared = 0
        while shared < min(len(chain), len(self.path)) and self.path[shared][0] == chain[shared]:
            shared += 1
        del self.path[shared:]
        for role, text, h in zip(roles[shared:], texts[shared:], chain[shared:]):
            formatted, a, z = turn_text(role, text)
            at, parent = self.size, self.path[-1][1] if self.path else -1
            self.pieces += (formatted[:a], formatted[a:z], formatted[z:])
            self.nodes.append({"begin": at, "end": at + len(formatted), "loss_begin": at + a, "loss_end": at + z, "parent": parent})
            self.path.append((h, len(self.nodes) - 1))
            self.parts.append(formatted)
            self.size += len(formatted)
        self.ends.append((key, self.path[-1][1]))

    def tokens(self, encoder) -> np.ndarray:
        """The tokens of all nodes in order; nodes get their places, positions and ancestors."""
        ids = list(encoder.ids(self.pieces))
        edge = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(int).tolist()
        for i, n in enumerate(self.nodes):
            n["token_begin"], n["loss_token_begin"], n["loss_token_end"], n["token_end"] = edge[3 * i : 3 * i + 4]
            up = self.nodes[n["parent"]] if n["parent"] >= 0 else None
            above = up["ancestors"] if up else []
            if up:  # neighbouring intervals are one
                begin = above[-1]["begin"] if above and above[-1]["end"] == up["token_begin"] else up["token_begin"]
                above = [*[x for x in above if x["begin"] < begin], {"begin": begin, "end": up["token_end"]}]
            n["position"], n["ancestors"] = up["position"] + up["token_end"] - up["token_begin"] if up else 0, above
        return np.concatenate([np.empty(0, np.uint32), *ids]).astype(np.int32)


def blocks(rows: DataFrame, path: str, key: str = "conv_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(text, tokens, nodes, keys, leaves): one row a block; conversation keys[i] ends in node leaves[i]. Tokens are
    those of the tokenizers file at path."""
    per = written(chains(rows, key), "chat")
    kind = per.schema[key].dataType
    fields = [("text", T.StringType()), ("tokens", T.ArrayType(T.IntegerType())), ("nodes", T.ArrayType(NODE)), ("keys", T.ArrayType(kind)), ("leaves", T.ArrayType(T.LongType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, arrow = _Block(), None

        def closed(b: _Block) -> pa.RecordBatch:
            tokens = b.tokens(encoder(path))
            row = ["".join(b.parts)], pa.ListArray.from_arrays([0, len(tokens)], pa.array(tokens)), [b.nodes], [[k for k, _ in b.ends]], [[n for _, n in b.ends]]
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(row, arrow)], schema=arrow)

        for b in batches:
            if arrow is None:
                node = pa.struct([(f, pa.int64()) for f in _PLACES] + [("ancestors", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])
                arrow = pa.schema([("text", pa.string()), ("tokens", pa.list_(pa.int32())), ("nodes", pa.list_(node)), ("keys", pa.list_(b.column(0).type)), ("leaves", pa.list_(pa.int64()))])
            for i in range(b.num_rows):
                open_.add(*[c[i].as_py() for c in b.columns])
                if open_.size + 64 * len(open_.ends) >= block_chars:
                    yield closed(open_)
                    open_ = _Block()
        if open_.ends:
            yield closed(open_)

    # Equal chains are dealt by the key as well, so that a conversation's copies do not meet in one task.
    dealt = per.repartitionByRange("chain", key).sortWithinPartitions("chain", key)
    return map_arrow(dealt, run, T.StructType([T.StructField(n, t) for n, t in fields]))


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation, from blocks."""
    kind = formatted.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField(key, kind), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                text, nodes, keys, leaves = (b.column(n)[row].as_py() for n in ("text", "nodes", "keys", "leaves"))
                out = []
                for at in leaves:
                    path, loss = [], []
                    while at >= 0:
                        n = nodes[at]
                        path.append(text[n["begin"] : n["end"]])
                        loss.append(unescaped(text[n["loss_begin"] : n["loss_end"]]))
                        at = n["parent"]
                    own, masked = "".join(reversed(path)), "".join(reversed(loss))
                    turns = turns_of(own)
                    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((len(turns), digest, len(masked), hashlib.sha256(masked.encode("utf-8", "surrogatepass")).hexdigest(), len(own)))
                yield pa.RecordBatch.from_arrays([pa.array(keys, b.column("keys").type.value_type), *[pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]], names=schema.names)

    return map_arrow(formatted, run, schema)
