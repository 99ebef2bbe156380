"""Byte-pair encoding as deterministic transducers that run over whole batches of text in arrays.

Two machines in a row replace the tokenizer's loops:

* ``Splitter``: a small automaton over character classes that marks where a pre-token starts. The text is cut
  into chunks; each chunk's map (state before -> state after) is made for every state at once, the maps are
  composed by a parallel prefix scan, and a second pass marks starts from the known states.
* ``Transducer``: reads a pre-token's bytes. After each prefix its encoding ends in exactly one token, so the
  state holds, for every suffix that some longer token could still complete, the place in the token trie, the
  token before the suffix (as a class: tokens that allow the same completions are one) and the number of tokens
  there against now. A transition's annotation is the change in the number of tokens. States are compiled when
  first met and kept for the worker's life; ``most_states`` bounds them, beyond it the machine starts afresh.

Both are exact. The library itself says once which class a character has and how a text outside ASCII is normalised;
only a text that holds a special string is encoded by it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np

from ._shared import kept_by

#: What lies outside has normal forms and cases that follow the library's own tables alone.
_RARE = re.compile(r"[^\x00-\u024f\u2010-\u206f\u3001-\u3029\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff]")
_GAP = re.compile(r"[^ \t-\r][ \t-\r]")
END, SYMBOL, LETTER, NUMBER, SPACE, WHITE, SHORT, LONG, SPACE_LAST, WHITE_LAST, UNKNOWN = range(11)
_classes = np.full(0x110000, UNKNOWN, np.uint8)
_classes[0x20] = SPACE


def char_classes(points: np.ndarray) -> np.ndarray:
    """The class of each code point, by the library's own expressions; the table fills as code points are met."""
    found = _classes[points]
    if (found == UNKNOWN).any():
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        new = np.unique(points[found == UNKNOWN])
        # Outside the planes of characters the encoder has no text; lone surrogates are symbols.
        new = new[(new < 0xD800) | (new > 0xDFFF)]
        text = "".join(map(chr, new.tolist()))
        _classes[0xD800:0xE000] = SYMBOL
        _classes[new] = SYMBOL
        for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
            rest = np.zeros(len(new), bool)
            for _, (a, z) in Split(Regex(pattern), "removed").pre_tokenize_str(text):
                rest[a:z] = True
            _classes[new[~rest]] = kind
        found = _classes[points]
    return found


class Splitter:
    """Marks pre-token starts. rules(state, class) -> (next state, whether a pre-token starts here)."""

    def __init__(self, states: int, rules, chunk: int = 64):
        self.states, self.chunk = states, chunk
        table = [[rules(s, c) for c in range(UNKNOWN)] for s in range(states)]
        self.next = np.array([[x[0] for x in row] for row in table], np.uint8)
        self.starts = np.array([[x[1] for x in row] for row in table], bool)

    def mark(self, classes: np.ndarray) -> np.ndarray:
        n, c = len(classes), self.chunk
        rows = -(-n // c)
        grid = np.zeros((rows, c), np.uint8)  # the rest reads END, which nothing follows
        grid.ravel()[:n] = classes
        by_step = np.ascontiguousarray(grid.T)
        flat = self.next.T.ravel().astype(np.uint8)  # class-major: next[class * states + state]
        maps = np.tile(np.arange(self.states, dtype=np.uint8), (rows, 1))
        base = by_step.astype(np.int32) * self.states
        for k in range(c):
            maps = flat[base[k][:, None] + maps]
        step = 1
        while step < rows:  # inclusive prefix scan of function composition
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
            step *= 2
        state = np.concatenate((np.zeros(1, np.uint8), maps[:-1, 0]))
        flags, out = self.starts.T.ravel(), np.empty((c, rows), bool)
        for k in range(c):
            at = base[k] + state
            out[k] = flags[at]
            state = flat[at]
        return out.T.ravel()[:n]


def _byte_level(state: int, c: int) -> tuple[int, bool]:
    """States: 0 fresh, 1 letters, 2 numbers, 3 symbols, 4 after a leading space, 5 white space, 6 and 7 one and
    two letters of a contraction to come."""
    if c == LETTER:
        return {1: (1, False), 4: (1, False), 7: (6, False), 6: (0, False)}.get(state, (1, True))
    if c == NUMBER:
        return (2, state not in (2, 4))
    if c == SYMBOL or (c in (SHORT, LONG) and state in (3, 4)):
        return (3, state not in (3, 4))
    if c in (SHORT, LONG):
        return (6 if c == SHORT else 7, True)
    if c in (SPACE, WHITE):
        return (5, state != 5)
    return (4 if c == SPACE_LAST else 0, True)


def _word_level(state: int, c: int) -> tuple[int, bool]:
    """States: 0 fresh, 1 letters, 2 symbols, 3 and 4 as 6 and 7 above. White space starts a piece that is dropped."""
    if c == LETTER:
        return {1: (1, False), 4: (3, False), 3: (0, False)}.get(state, (1, True))
    if c == SYMBOL or (c in (SHORT, LONG) and state == 2):
        return (2, state != 2)
    if c in (SHORT, LONG):
        return (3 if c == SHORT else 4, True)
    return (0, True)


def _unicode_bytes() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Compiled on demand from a vocabulary and its merges. A symbol is a byte, or 256 + byte at a word's end."""

    def __init__(self, model: dict, most_states: int = 150_000, same_class: int = 24):
        to_byte, suffix = _unicode_bytes(), model.get("end_of_word_suffix") or ""
        spell = lambda t: [to_byte[c] for c in t]
        symbols = {}
        for t, i in model["vocab"].items():
            ends = bool(suffix) and t.endswith(suffix)
            s = spell(t[: -len(suffix)] if ends else t)
            symbols[i] = (*s[:-1], s[-1] + 256) if ends else tuple(s)
        self.length = np.zeros(max(symbols) + 1, np.int32)
        for i, s in symbols.items():
            self.length[i] = len(s)
        vocab = model["vocab"]
        self.merged, self.parts, self.rank = {}, {}, dict.fromkeys(symbols, -1)
        for r, (a, b) in enumerate(model["merges"]):
            new = vocab[a + b]
            self.merged[vocab[a] << 32 | vocab[b]] = r
            self.parts[new], self.rank[new] = (vocab[a], vocab[b]), r
        self.kids: list[dict[int, int]] = [{}]
        self.token = [-1]
        for i, s in symbols.items():
            n = 0
            for x in s:
                if x not in self.kids[n]:
                    self.kids[n][x] = len(self.kids)
                    self.kids.append({})
                    self.token.append(-1)
                n = self.kids[n][x]
            self.token[n] = i
        self.most_states, self.same_class = most_states, same_class
        self.below: dict[int, tuple] = {}
        self.reset()

    def reset(self) -> None:
        start = ((0, -1, 0),)
        self.ids, self.held = {start: 0}, [start]
        self.pairs: dict[int, bool] = {}
        self.classes: dict[int, int] = {}
        self.alike: dict[tuple, int] = {}
        self.column = np.full(512, -1, np.int16)
        self.columns = 0
        self.width, self.next = 64, np.full((4096, 64), -1, np.int32)
        self.last = np.full(4096, -1, np.int32)

    def follows(self, a: int, b: int) -> bool:
        """Whether an encoding can hold token b right after token a: no merge across them comes before the
        merges that made their touching parts."""
        if a < 0:
            return True
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is not None:
            return known
        before, rank, parts = 1 << 60, self.rank, self.parts
        while True:
            r = self.merged.get(a << 32 | b)
            if r is not None and r < before:
                ok = False
                break
            ra, rb = rank[a], rank[b]
            if ra > rb:
                before, a = ra, parts[a][1]
            elif rb >= 0:
                before, b = rb + 1, parts[b][0]
            else:
                ok = True
                break
        self.pairs[key] = ok
        return ok

    def _tokens_below(self, node: int) -> tuple:
        found = self.below.get(node)
        if found is None:
            out, stack = [], list(self.kids[node].values())
            while stack and len(out) <= self.same_class:
                n = stack.pop()
                if self.token[n] >= 0:
                    out.append(self.token[n])
                stack += self.kids[n].values()
            found = self.below[node] = () if len(out) > self.same_class else tuple(out)
        return found

    def _class(self, node: int, before: int) -> int:
        """A token that allows the same completions of node as ``before`` does; -2 if it allows none."""
        key = node << 32 | before
        known = self.classes.get(key)
        if known is None:
            below = self._tokens_below(node)
            known = before
            if below:
                able = tuple(t for t in below if self.follows(before, t))
                known = self.alike.setdefault((node, able), before) if able else -2
            self.classes[key] = known
        return known

    def compile(self, state: int, symbol: int) -> int:
        """Make one transition and return it as next state << 8 | change in tokens + 128."""
        open_, done = [], None
        for node, before, count in self.held[state]:
            child = self.kids[node].get(symbol)
            if child is None:
                continue
            if self.token[child] >= 0 and self.follows(before, self.token[child]):
                done = self.token[child], count + 1
            if self.kids[child]:
                of = before if before < 0 else self._class(child, before)
                if of != -2:
                    open_.append((child, of, count))
        token, change = done
        key = (*[(n, b, c - change) for n, b, c in open_], (0, token, 0))
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.held)
            self.held.append(key)
            if to >= len(self.next):
                more = max(4096, to // 4)
                self.next = np.concatenate((self.next, np.full((more, self.width), -1, np.int32)))
                self.last = np.concatenate((self.last, np.full(more, -1, np.int32)))
            self.last[to] = token
        value = to << 8 | change + 128
        self.next[state, self.column[symbol]] = value
        return value

    def _columns(self, symbols: np.ndarray) -> np.ndarray:
        new = np.flatnonzero(np.bincount(symbols, minlength=512) > 0)
        for x in new[self.column[new] < 0].tolist():
            if self.columns == self.width:
                self.next = np.concatenate((self.next, np.full((len(self.next), 32), -1, np.int32)), axis=1)
                self.width += 32
            self.column[x] = self.columns
            self.columns += 1
        return self.column[symbols]

    def run(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray | None = None, trace: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(end state, change in tokens) of each stretch symbols[begin : begin + size], all in step."""
        cols = self._columns(symbols)
        order = np.argsort(-size, kind="stable")
        at, left = begin[order], size[order]
        s = np.zeros(len(at), np.int64) if state is None else state[order].astype(np.int64)
        n = np.zeros(len(at), np.int32)
        live = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
        for k, m in enumerate(live.tolist()):
            c = cols[at[:m] + k]
            v = self.next.ravel()[s[:m] * self.width + c]
            gone = np.flatnonzero(v < 0)
            if len(gone):
                pair, back = np.unique(s[gone] << 16 | symbols[at[gone] + k], return_inverse=True)
                v[gone] = np.array([self.compile(p >> 16, p & 0xFFFF) for p in pair.tolist()], np.int32)[back]
            s[:m] = v >> 8
            n[:m] += (v & 255) - 128
            if trace is not None:
                trace[at[:m] + k] = s[:m]
        state_out, n_out = np.empty_like(s), np.empty_like(n)
        state_out[order], n_out[order] = s, n
        return state_out, n_out

    def encode(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, trace: np.ndarray | None = None, piece: int = 1024) -> np.ndarray:
        """The number of tokens of each pre-token. Long ones run as pieces, all at once from guessed states; a
        piece whose guess turns out wrong runs again from the end of the piece before, until none is."""
        if len(self.held) > self.most_states or len(self.pairs) > 4 * self.most_states:
            self.reset()
        out = np.zeros(len(begin), np.int64)
        short = size <= piece
        out[short] = self.run(symbols, begin[short], size[short], trace=trace)[1]
        for i in np.flatnonzero(~short).tolist():
            b = np.arange(begin[i], begin[i] + size[i], piece)
            z = np.minimum(piece, begin[i] + size[i] - b)
            start, end, n = np.zeros(len(b), np.int64), np.full(len(b), -1, np.int64), np.zeros(len(b), np.int64)
            todo = np.arange(len(b))
            while len(todo):
                end[todo], n[todo] = self.run(symbols, b[todo], z[todo], start[todo], trace)
                follow = np.concatenate(([0], end[:-1]))
                todo = np.flatnonzero(follow != start)
                start = follow
            out[i] = n.sum()
        return out

    def tokens(self, trace: np.ndarray, begin: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The ids of all pre-tokens in order, read back from the states: a prefix's last token ends there."""
        to = np.cumsum(count)
        out = np.empty(int(to[-1]) if len(to) else 0, np.uint32)
        end, slot, begin = begin + size, to.copy(), begin.copy()
        while len(end):
            t = self.last[trace[end - 1]]
            slot = slot - 1
            out[slot] = t
            end = end - self.length[t]
            more = end > begin
            end, slot, begin = end[more], slot[more], begin[more]
        return out


class Encoder:
    """Counts or ids of whole texts as the tokenizers library gives them for one of its .json files."""

    def __init__(self, path: str, most_states: int = 150_000, block: int = 1 << 19):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.words = bool(model.get("end_of_word_suffix"))
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [str(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.machine = Transducer(model, most_states)
        self.splitter = Splitter(5, _word_level) if self.words else Splitter(8, _byte_level)
        self.block = block

    def _plain(self, text: str) -> str | None:
        """The text as the pre-tokenizer sees it, or None where the library has to encode it."""
        if any(s in text for s in self.special):
            return None
        if not self.words or not text:
            return text
        if text.isascii():
            text = text.lower()
        elif _RARE.search(text):
            text = self.library.normalizer.normalize_str(text)
        else:
            text = unicodedata.normalize("NFC", text).lower()
        return None if any(s in text for s in self.special) else text

    def _run(self, texts: Sequence[str], ids: bool) -> list:
        """Of each text the number of tokens or the ids."""
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(size + 1) - 1
        c = char_classes(points)
        c[ends] = END
        quote = np.flatnonzero(points == 39)
        if len(quote):
            padded = np.concatenate((points, np.zeros(2, np.uint32)))
            a, b = padded[quote + 1], padded[quote + 2]
            c[quote[np.isin(a, [ord(x) for x in "stmd"])]] = SHORT
            c[quote[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]] = LONG
        white = (c == SPACE) | (c == WHITE)
        if not self.words:
            last = np.flatnonzero(white[:-1] & ~white[1:] & (c[1:] != END))
            c[last] += SPACE_LAST - SPACE
        begin = np.flatnonzero(self.splitter.mark(c))
        width = 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
        offset = np.concatenate(([0], np.cumsum(width)))
        raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
        bounds = offset[np.append(begin, len(points))]
        real = (c[begin] != END) & (~white[begin] if self.words else True)
        at, n = bounds[:-1][real], np.diff(bounds)[real]
        if self.words:
            raw[at + n - 1] += 256
        of = np.searchsorted(ends, begin[real])
        trace = np.zeros(len(raw), np.int32) if ids else None
        count = self.machine.encode(raw, at, n, trace)
        total = np.bincount(of, weights=count, minlength=len(texts)).astype(np.int64)
        return np.split(self.machine.tokens(trace, at, n, count), np.cumsum(total)[:-1]) if ids else total.tolist()

    def _all(self, texts: Sequence[str], ids: bool) -> Iterator:
        plain = [self._plain(t) for t in texts]
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(plain[to] or "") <= self.block):
                chars += len(plain[to] or "")
                to += 1
            for t, p, x in zip(texts[at:to], plain[at:to], self._run([p or "" for p in plain[at:to]], ids)):
                if p is None:
                    found = self.library.encode(t, add_special_tokens=False).ids
                    x = np.array(found, np.uint32) if ids else len(found)
                yield x
            at = to

    def cuts(self, text: str) -> list[str]:
        """A long text in parts of about a block, cut where white space follows another character: a pre-token
        starts there in either kind of file. Without such a place the text stays whole."""
        if len(text) <= 4 * self.block or any(s in text for s in self.special):
            return [text]
        out, at = [], 0
        while len(text) - at > 2 * self.block:
            m = _GAP.search(text, at + self.block)
            if not m:
                break
            out.append(text[at : m.start() + 1])
            at = m.start() + 1
        return [*out, text[at:]]

    def _each(self, texts: Sequence[str], ids: bool) -> Iterator:
        """Runs of ordinary texts are encoded together, a long one by its parts."""
        run: list[str] = []
        for t in texts:
            if len(t) > 4 * self.block:
                yield from self._all(run, ids)
                run, parts = [], self._all(self.cuts(t), ids)
                yield np.concatenate(list(parts)) if ids else sum(parts)
            else:
                run.append(t)
        yield from self._all(run, ids)

    def each_count(self, texts: Sequence[str]) -> Iterator[int]:
        return self._each(texts, False)

    def counts(self, texts: Sequence[str]) -> list[int]:
        return list(self.each_count(texts))

    def ids(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        return self._each(texts, True)


def encoder(path: str, most_states: int = 150_000) -> Encoder:
    """The worker's own encoder of a file; its compiled states serve all of the worker's tasks."""
    held, key = kept_by("encoder"), (path, most_states)
    if key not in held:
        held[key] = Encoder(path, most_states)
    return held[key]
