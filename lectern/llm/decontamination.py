"""Benchmark decontamination: passages within a small edit distance of a benchmark item.

Texts become lower-cased words joined by single spaces, as bytes. The CGK embedding walks such a text with a random
bit for each (step, byte) that says whether the walk moves on, so that windows at a small edit distance give
outputs at a small Hamming distance. A window starts at every word and is walked for some 30 steps (``SIZES``, by the
item's size), about half as many characters; an item's windows cover it from end to end. An embedding's distance grows
with the square of the edits, so windows of this size, of which an edited passage leaves some nearly whole, find more
than a single window as long as the item. Repeated samples of the walks' outputs are looked up among the items' samples. What meets there
must share enough runs of four bytes with the item, about where the item has them; then the exact edit distance of the whole
item to that stretch of the document, in characters, decides. Walks' outputs that many items share are looked up like any
other, in runs of bounded size.

Items of fewer than ``LEAST`` characters have too few windows and are found exactly: one of an item's k + 1 pieces stands
unchanged in any passage within k edits, and about each place of a piece the edit distance is computed.

Items are broadcast in blocks bounded by ``BLOCK_ITEMS`` and ``BLOCK_CHARS``, one after another; documents are read
once a block and never shuffled.

Defined cases: a null or empty text or item has no words and matches nothing; items of any length are looked for with the
same similarity, so very short ones are found within longer words too; texts are read whole; repeated rows and equal items are each
reported; a null id stays null; of several places of one item in a document the one of the least distance, then the
first, is reported; extra columns are ignored in ``contaminated`` and stay in ``clean``; empty tables give empty
(``clean``: unchanged) results.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import by_place, kept_by, map_arrow, only, written

SIMILARITY, SEED = 0.8, 20
#: Of items up to so many bytes: steps of a walk, walks, samples of each, outputs in a sample. Short items have few windows.
SIZES = ((100, (26, 3, 4, 10)), (1 << 40, (34, 2, 4, 12)))
LEAST, BLOCK_ITEMS, BLOCK_CHARS = 32, 20_000, 8_000_000
#: A key that over HOT windows share is common: what it finds is looked at in runs of RUN, so that memory stays bounded.
HOT, RUN = 64, 1 << 20
#: Characters of a short item's piece, and places whose distance is computed together.
PIECE, LANES = 4, 1 << 15
GRAM, STEP, SHARED = 4, 16, 0.3
#: Scripts without spaces give one word a character.
WORD = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\x00-\x2f\x3a-\x60\x7b-\x7f぀-ヿ㐀-鿿가-힯 -¿ -⁯　-〿＀-／]+")
_OTHER = re.compile(r"[぀-ヿ㐀-鿿가-힯 -¿ -⁯　-〿＀-／]")
_BYTES = np.full(256, 32, np.uint8)
_BYTES[48:58], _BYTES[97:123], _BYTES[128:] = range(48, 58), range(97, 123), range(128, 256)
END = 10


class Flat:
    """Texts as one array of bytes: words by single spaces, END after each text. ``start`` holds the words' places,
    ``of`` their texts, ``first`` the number of each text's first word, ``end`` each text's END."""

    def __init__(self, texts: list[str | None]):
        parts = []
        for t in texts:
            t = (t or "").lower()
            if not t.isascii() and _OTHER.search(t):
                t = " ".join(WORD.findall(t))
            parts.append(t.encode("utf-8", "surrogatepass"))
        raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        x = _BYTES[raw]
        x[np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1] = END
        blank = x <= 32
        before = np.concatenate(([True], blank[:-1]))
        x = x[~(blank & before) | (x == END)]  # the first blank of a run stays, and every END
        letter = x > 32
        self.x = x
        self.start = np.flatnonzero(letter & ~np.concatenate(([False], letter[:-1])))
        self.end = np.flatnonzero(x == END)
        self.of = np.searchsorted(self.end, self.start)
        self.first = np.searchsorted(self.start, np.concatenate(([0], self.end[:-1] + 1)))

    def grams(self) -> np.ndarray:
        """The GRAM bytes that begin at each place, as a number."""
        n = max(len(self.x) - GRAM + 1, 0)
        h = np.zeros(n, np.uint32)
        for j in range(GRAM):
            h = h << np.uint32(8) | self.x[j : n + j]
        return h


class Sampler:
    """Keys of windows: ``walks`` embeddings of a window, each sampled ``samples`` times."""

    def __init__(self, steps: int, walks: int, samples: int, sampled: int):
        rng = np.random.default_rng([SEED, steps])
        self.steps = steps
        self.moves = rng.integers(0, 1 << 63, (walks, 256), dtype=np.uint64)
        self.moves[:, END] = 0  # a walk stays at its text's end
        self.at = [[np.sort(rng.choice(steps, sampled, replace=False)).tolist() for _ in range(samples)] for _ in range(walks)]
        self.by = rng.integers(1, 1 << 62, sampled, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, flat: Flat) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each sample the keys of the windows at all words, and which windows end within their text."""
        for moves, samples in zip(self.moves, self.at):
            place, seen = flat.start.copy(), []
            for j in range(self.steps):
                symbol = flat.x[place]
                seen.append(symbol)
                place += ((moves[symbol] >> np.uint64(j)) & np.uint64(1)).view(np.int64)
            whole = flat.x[place] != END
            for positions in samples:
                key = np.zeros(len(place), np.uint64)
                for by, j in zip(self.by, positions):
                    key += seen[j]
                    key *= by
                yield key ^ (key >> np.uint64(31)), whole


def distance(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to a stretch of the text, where the first such stretch ends).
    One bit-parallel column of the dynamic programme for each character of the text."""
    m = len(pattern)
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        where[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, now = full, 0, m
    best, best_at = m, 0
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        x = eq | down
        flat = (((eq & up) + up) ^ up) | eq | down
        plus = (down | ~(flat | up)) & full
        minus = up & flat
        if plus & top:
            now += 1
        elif minus & top:
            now -= 1
        plus = plus << 1 & full  # a stretch may start anywhere: row 0 stays 0
        minus = minus << 1 & full
        up = (minus | ~(x | plus)) & full
        down = plus & x
        if now < best:
            best, best_at = now, j + 1
    return best, best_at


def _ranges(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each range, one range after another."""
    return np.repeat(begin - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())


def _runs(many: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts of counts into runs whose sums are about ``most``, or one count."""
    edge = np.flatnonzero(np.diff(np.cumsum(many) // most, prepend=-1, append=1 << 62)) if len(many) else []
    yield from zip(edge[:-1], edge[1:])


def _bit(gram: np.ndarray, place: np.ndarray) -> np.ndarray:
    """13 bits of a gram and of where it stands, to STEP places."""
    h = gram * np.uint32(0x9E3779B1) + (place // STEP + 1).astype(np.uint32) * np.uint32(0x85EBCA6B)
    return ((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(19)).astype(np.int64)


class Short:
    """Items of under 64 characters, found exactly. number: which of the block's texts each is."""

    def __init__(self, texts: list[str], number: list[int], similarity: float):
        self.texts, self.number = texts, np.array(number)
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.most = np.minimum([int(n * (1 - similarity) + 1e-9) for n in self.size.tolist()], self.size - 1)
        symbols = {c: n for n, c in enumerate(sorted(set("".join(texts))), 1)}
        self.symbol = np.zeros(max(map(ord, symbols)) + 2, np.int64)  # 0: in no item, as is all beyond the last
        self.symbol[[ord(c) for c in symbols]] = list(symbols.values())
        self.where = np.zeros((len(texts), len(symbols) + 1), np.uint64)
        pieces: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for i, (t, k) in enumerate(zip(texts, self.most.tolist())):
            for j, c in enumerate(t):
                self.where[i, symbols[c]] |= np.uint64(1 << j)
            step = len(t) // (k + 1)
            n = min(step, PIECE)
            for o in range(0, (k + 1) * step, step):
                pieces[n].append((int(self._codes(np.array([symbols[c] for c in t[o : o + n]]), n)[0]), i, o))
        self.pieces = {n: tuple(np.array(x) for x in zip(*sorted(own))) for n, own in pieces.items()}

    def _codes(self, symbol: np.ndarray, n: int) -> np.ndarray:
        """The n symbols that begin at each place, as a number."""
        code = np.zeros(max(len(symbol) - n + 1, 0), np.int64)
        for j in range(n):
            code = code * self.where.shape[1] + symbol[j : len(code) + j]
        return code

    def _places(self, symbol: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, where it would begin) of the pieces in a text, in runs."""
        for n, (known, item, offset) in self.pieces.items():
            code = self._codes(symbol, n)
            some = np.zeros(1 << 16, bool)  # most places of documents end here
            some[known & 0xFFFF] = True
            at = np.flatnonzero(some[code & 0xFFFF])
            lo, hi = np.searchsorted(known, code[at], "left"), np.searchsorted(known, code[at], "right")
            at, lo, many = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            for a, z in _runs(many, RUN):
                w = _ranges(lo[a:z], many[a:z])
                pair = np.unique(item[w] * (1 << 40) + np.repeat(at[a:z], many[a:z]) - offset[w] + (1 << 20))
                yield pair >> 40, (pair & (1 << 40) - 1) - (1 << 20)

    def _distances(self, symbol: np.ndarray, item: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least distance, where its first stretch ends) of items from begin on, as in ``distance`` but many at once."""
        one = np.uint64(1)
        size = self.size[item]
        full, top = (one << size.astype(np.uint64)) - one, one << (size - 1).astype(np.uint64)
        up, down, now = full.copy(), np.zeros(len(item), np.uint64), size.copy()
        best, best_at = size.copy(), begin.copy()
        for j in range(int((size + 2 * self.most[item]).max(initial=0))):
            eq = self.where[item, symbol[np.minimum(begin + j, stop)]]  # a text's end is no item's symbol and betters nothing
            x = eq | down
            flat = (((eq & up) + up) ^ up) | eq | down
            plus = (down | ~(flat | up)) & full
            minus = up & flat
            now += (plus & top != 0).astype(np.int64) - (minus & top != 0)
            plus, minus = plus << one & full, minus << one & full
            up = (minus | ~(x | plus)) & full
            down = plus & x
            better = now < best
            best[better], best_at[better] = now[better], begin[better] + j + 1
        return best, best_at

    def found(self, texts: list[str | None]) -> dict[int, dict[int, tuple[int, int, int]]]:
        """{row: {item: (distance, first word, end word)}} of the texts that hold items."""
        plain = [" ".join(WORD.findall((t or "").lower())) for t in texts]
        end = np.cumsum([len(t) + 1 for t in plain]) - 1
        start = np.concatenate(([0], end[:-1] + 1))
        raw = np.frombuffer(("\n".join(plain) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = self.symbol[np.minimum(raw, len(self.symbol) - 1)]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for item, place in self._places(symbol):
            of = np.searchsorted(end, np.clip(place + self.size[item] // 2, 0, len(raw) - 1))
            for a in range(0, len(item), LANES):
                i, t = item[a : a + LANES], of[a : a + LANES]
                begin = np.clip(place[a : a + LANES] - self.most[i], start[t], end[t])
                d, at = self._distances(symbol, i, begin, end[t])
                for row, x, n, z in zip(*(c[d <= self.most[i]].tolist() for c in (t, i, d, at))):
                    best[row, x] = min(best.get((row, x), (n, z)), (n, z))
        out: dict[int, dict[int, tuple[int, int, int]]] = defaultdict(dict)
        for (row, i), (d, at) in best.items():
            text, item, to = plain[row], self.texts[i], at - int(start[row])
            _, size = distance(item[::-1], text[max(0, to - len(item) - d) : to][::-1])
            first = text[: to - size].count(" ") + (text[to - size] == " ")
            out[row][int(self.number[i])] = (d, first, text[:to].count(" ") + 1)
        return out


class Index:
    """The sample keys of a block of different item texts, and their exact check."""

    def __init__(self, texts: list[str], similarity: float):
        """texts: items' words joined by single spaces."""
        self.similarity, self.texts = similarity, texts
        few = [i for i, t in enumerate(texts) if 0 < len(t) < LEAST]
        self.short = Short([texts[i] for i in few], few, similarity) if few else None
        long = np.fromiter((len(t) >= LEAST for t in texts), bool, len(texts))
        flat = Flat(texts)
        begin = np.concatenate(([0], flat.end[:-1] + 1))
        self.size = flat.end - begin
        self.held = np.zeros((len(texts), 1 << 10), np.uint8)  # 2**13 bits an item
        grams = flat.grams()
        at = np.arange(len(grams)) - begin[np.searchsorted(flat.end, np.arange(len(grams)))]
        for i, (a, z) in enumerate(zip(begin.tolist(), flat.end.tolist())):
            own, place = grams[a : max(z - GRAM + 1, a)], at[a : max(z - GRAM + 1, a)]
            bits = np.zeros(1 << 13, bool)
            for near in (-STEP, 0, STEP):
                bits[_bit(own, place + near)] = True
            self.held[i] = np.packbits(bits, bitorder="little")
        self.window_item = flat.of
        self.window_word = np.arange(len(flat.start)) - flat.first[flat.of]
        self.window_place = flat.start - begin[flat.of]
        self.tables = []
        for (low, _), (high, parameters) in zip(((0, None), *SIZES), SIZES):
            own = (long & (self.size > low) & (self.size <= high))[flat.of]
            if own.any():
                sampler = Sampler(*parameters)
                self.tables.append((sampler, self._tables([(key, np.flatnonzero(whole & own)) for key, whole in sampler.keys(flat)])))

    def _tables(self, sampled: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
        """(sorted keys, their windows, which leading bits occur, shift to these) of each sample (keys, windows)."""
        out = []
        for key, window in sampled:
            window = window[np.argsort(key[window], kind="stable")]
            key, window = key[window], window.astype(np.int32)
            bits = max(10, math.ceil(math.log2(16 * len(key) + 1)))
            some = np.zeros(1 << bits, bool)  # most windows of documents end here
            some[(key >> np.uint64(64 - bits)).view(np.int64)] = True
            out.append((key, window, some, np.uint64(64 - bits)))
        return out

    def candidates(self, flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, item): the item may start about at that word of flat, which can lie before the text's first."""
        words, windows, common = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
        for sampler, tables in self.tables:
            for (key, _), (known, window, some, shift) in zip(sampler.keys(flat), tables):
                p = np.flatnonzero(some[(key >> shift).view(np.int64)])
                lo, hi = np.searchsorted(known, key[p], "left"), np.searchsorted(known, key[p], "right")
                many = hi - lo
                few, more = (many > 0) & (many <= HOT), many > HOT
                words.append(np.repeat(p[few], many[few]))
                windows.append(window[_ranges(lo[few], many[few])].astype(np.int64))
                common.append((p[more], lo[more], many[more], window))
        found = [self._near(flat, np.concatenate(words), np.concatenate(windows))]
        for p, lo, many, window in common:
            for a, z in _runs(many, RUN):
                found.append(self._near(flat, np.repeat(p[a:z], many[a:z]), window[_ranges(lo[a:z], many[a:z])].astype(np.int64)))
        of, word, item = (np.concatenate(x) for x in zip(*found))
        return of, word, item

    def _near(self, flat: Flat, p: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates of windows w met at words p."""
        item, of, word = self.window_item[w], flat.of[p], p - self.window_word[w]
        # One of the places that give an item the same first word is enough.
        order = np.lexsort((word, item, of))
        new = np.concatenate((np.ones(min(1, len(p)), bool), (np.diff(of[order]) != 0) | (np.diff(item[order]) != 0) | (np.diff(word[order]) != 0)))
        at = order[new]
        near = at[self._alike(flat, flat.start[p[at]] - self.window_place[w[at]], item[at], of[at])]
        return of[near], word[near], item[near]

    def _alike(self, flat: Flat, place: np.ndarray, item: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Whether enough grams of the text about place, as far as the item goes, are the item's, about where it has them."""
        grams, size = flat.grams(), self.size[item]
        begin = np.concatenate(([0], flat.end[:-1] + 1))[of]
        a = np.maximum(place - size // 10, begin)
        z = np.maximum(np.minimum(np.minimum(place + size + size // 10, flat.end[of]) - GRAM + 1, len(grams)), a)
        many, out, at = z - a, np.zeros(len(place), np.int64), 0
        while at < len(place):
            to = at + max(1, int(np.searchsorted(np.cumsum(many[at:]), 1 << 20)))
            read = _ranges(a[at:to], many[at:to])
            row = np.repeat(np.arange(at, min(to, len(place))), many[at:to])
            g = _bit(grams[read], read - place[row])
            hit = (self.held[item[row], g >> 3] >> (g & 7).astype(np.uint8)) & 1
            out[at:to] = np.bincount(row - at, weights=hit, minlength=min(to, len(place)) - at).astype(np.int64)
            at = to
        return out >= SHARED * size

    def verified(self, words: list[str], places: list[tuple[int, int]]) -> dict[int, tuple[int, int, int]]:
        """{item: (distance, first word, end word)} of a document's candidate places (word, item)."""
        best: dict[int, tuple[int, int, int]] = {}
        by_item: dict[int, list[int]] = defaultdict(list)
        edge = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
        for p, i in places:
            by_item[i].append(p)
        for i, starts in by_item.items():
            text = self.texts[i]
            most = int(len(text) * (1 - self.similarity) + 1e-9)
            stretches: list[list[int]] = []
            for p in sorted(starts):  # the passage begins and ends at most that many characters from where it seems to
                a, b = np.searchsorted(edge, (edge[p] - most - 1, edge[p] + len(text) + most + 2)).tolist()
                a, b = max(0, a - 1), min(len(words), b)
                if stretches and a <= stretches[-1][1]:
                    stretches[-1][1] = max(b, stretches[-1][1])
                else:
                    stretches.append([a, b])
            for a, b in stretches:
                stretch = " ".join(words[a:b])
                if (whole := stretch.find(text)) >= 0:
                    d, to, back, size = 0, whole + len(text), 0, len(text)
                else:
                    d, to = distance(text, stretch)
                    back, size = distance(text[::-1], stretch[:to][::-1]) if d <= most else (d, 0)
                if d <= most and d < best.get(i, (most + 1,))[0]:
                    first = a + stretch[: to - size].count(" ") if back == d else a
                    if to - size < len(stretch) and stretch[to - size] == " ":
                        first += 1
                    best[i] = (d, first, a + stretch[:to].count(" ") + 1)
        return best


def _found(known: Index, texts: pa.Array, block_chars: int = 400_000) -> Iterator[tuple[int, dict[int, tuple[int, int, int]]]]:
    """(row, {item: (distance, first word, end word)}) of the texts that hold items."""
    at = 0
    while at < len(texts):
        some, many, first = [], 0, at
        while at < len(texts) and (not some or many < block_chars):
            some.append(texts[at].as_py())
            many += len(some[-1] or "")
            at += 1
        flat = Flat(some)
        if not len(flat.start) or not known.texts:
            continue
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for d, w, i in zip(*(c.tolist() for c in known.candidates(flat))):
            places[d].append((max(0, w - int(flat.first[d])), i))
        short = known.short.found(some) if known.short else {}
        for d in sorted(places.keys() | short.keys()):
            got = known.verified(WORD.findall(some[d].lower()), places[d]) if d in places else {}
            if got := got | short.get(d, {}):
                yield first + d, got


def _matches(index, ids: list[list]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("decontamination")
        known: Index = index.value
        for b in batches:
            rows = []
            for row, got in _found(known, b.column(1)):
                spans = [m.span() for m in WORD.finditer(b.column(1)[row].as_py().lower())]
                rows += [(row, i, x, 1 - x / len(known.texts[t]), spans[a][0], spans[e - 1][1]) for t, (x, a, e) in sorted(got.items()) for i in ids[t]]
            if rows:
                row, *cols = zip(*rows)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["key", "item", "distance", "similarity", "start", "end"]
                )

    return run


def _without(index, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("decontamination")
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            keep[[row for row, _ in _found(index.value, b.column(column))]] = False
            yield b.filter(pa.array(keep))

    return run


def _blocks(items: DataFrame, item: str, block_items: int, block_chars: int) -> tuple[int, DataFrame]:
    """(number of blocks, items as (i, t, b)): a block holds about half of what it may."""
    some = only(items, item, "text").select(F.col(item).cast("long").alias("i"), F.col("text").alias("t")).where(F.length("t") > 0)
    n, chars = some.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    blocks = 1 if n <= block_items and chars <= block_chars else math.ceil(2 * max(n / block_items, chars / block_chars))
    return blocks, some.withColumn("b", F.pmod(F.xxhash64("t"), F.lit(blocks)))


def _index(some: DataFrame, block: int, similarity: float) -> tuple:
    """(broadcast index, the ids of each of its texts) of one block."""
    by: dict[str, list] = defaultdict(list)
    for r in some.where(F.col("b") == block).orderBy("i", "t").collect():  # bounded by the block's size
        text = " ".join(WORD.findall(r["t"].lower()))
        if text:
            by[text].append(r["i"])
    return some.sparkSession.sparkContext.broadcast(Index(list(by), similarity)), list(by.values())


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", similarity: float = SIMILARITY, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(key, item, distance, similarity, start, end): one row for each document and item found in it, with the
    characters of the lower-cased text that the passage takes."""
    d = only(docs, key, "text")
    kind = T.StructType([d.schema[key], *[T.StructField(n, t()) for n, t in ((item, T.LongType), ("distance", T.LongType), ("similarity", T.DoubleType), ("start", T.LongType), ("end", T.LongType))]])
    raw = T.StructType([T.StructField("key", d.schema[key].dataType), T.StructField("item", T.LongType()), *kind.fields[2:]])
    blocks, some = _blocks(items, item, block_items, block_chars)
    out = None
    for b in range(blocks):
        index, ids = _index(some, b, similarity)
        part = map_arrow(d, _matches(index, ids), raw).toDF(*kind.names)
        if blocks > 1:  # one index at a time stands on the executors
            part = written(part, "decontamination")
            index.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def clean(
    docs: DataFrame, items: DataFrame, item: str = "item_id", similarity: float = SIMILARITY, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """docs, all columns, without the documents that hold a passage of an item. A row is judged where it stands:
    nothing is joined or moved."""
    rows, _ = by_place(docs)
    blocks, some = _blocks(items, item, block_items, block_chars)
    for b in range(blocks):
        index, _ = _index(some, b, similarity)
        rows = map_arrow(rows, _without(index, docs.columns.index("text")), rows.schema)
        if blocks > 1:
            rows = written(rows, "decontamination")
            index.destroy()
    return rows.toDF(*docs.columns)
