"""Token counts by two compiled deterministic transducers.

*Pretokens.* The splitting pattern, with its one look-ahead folded into the input symbols, is
an 8-state machine over character classes that marks the first character of each pretoken. A
run over many texts is cut in chunks. Each chunk's map from entry state to exit state is
computed for all states at once, the maps compose by a parallel prefix scan, and all chunks are
then run together from their known entry states.

*Tokens.* Byte-pair merging of a pretoken is itself a finite-state map. The last token of every
prefix's encoding follows from a few trailing bytes and the last tokens ending there, because a
token may follow another exactly when the two encode to themselves side by side. A state holds
that window; its transition by a byte carries the change in the number of tokens. Transitions
are compiled from the vocabulary when first met and kept for the life of the worker, and all
pretokens of a slice are run in step.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm import frames

SPECIAL = "<|endoftext|>"
TOKEN_LIMIT = 512
CHUNK = 256
# States a worker keeps, a few hundred bytes each.
MOST_STATES = 600_000
# States of the pretoken machine; any character begins a pretoken after CLOSED.
CLOSED, IN_L, IN_N, IN_O, JOIN, IN_S, NEED1, NEED2 = range(8)
# Its symbols: letter, number, other, a space before a non-space, other white space before a
# non-space, white space before white space or the end, an apostrophe that a contraction of
# one or two letters follows. The first character of a text has its symbol plus FIRST.
LETTER, NUMBER, OTHER, SPACE, LONE, BLANK, SHORT1, SHORT2 = range(8)
FIRST = 8


def _machine() -> tuple[np.ndarray, np.ndarray]:
    to = np.zeros((8, 16), np.uint8)
    begins = np.ones((8, 16), bool)
    for state in range(8):
        for symbol, inside in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O)):
            to[state, symbol] = inside
            begins[state, symbol] = state not in (inside, JOIN)
        to[state, SPACE] = JOIN
        to[state, LONE] = CLOSED
        to[state, BLANK] = IN_S
        begins[state, BLANK] = state != IN_S
        for symbol, need in ((SHORT1, NEED1), (SHORT2, NEED2)):
            joined = state in (IN_O, JOIN)
            to[state, symbol] = IN_O if joined else need
            begins[state, symbol] = not joined
    to[NEED1, LETTER], begins[NEED1, LETTER] = CLOSED, False
    to[NEED2, LETTER], begins[NEED2, LETTER] = NEED1, False
    to[:, FIRST:] = to[CLOSED, :FIRST]
    begins[:, FIRST:] = True
    return to, begins


TO, BEGINS = _machine()


class CharacterClasses:
    """How the library's own splitting takes a code point: letter, number, other or white space (3).

    Code points are looked up in the library when first met.
    """

    UNKNOWN = 255

    def __init__(self, json_path: str):
        from tokenizers import Tokenizer

        self.split = Tokenizer.from_file(json_path).pre_tokenizer
        self.table = np.full(0x110000, self.UNKNOWN, np.uint8)
        self.table[0x20] = 3

    def of(self, points: np.ndarray) -> np.ndarray:
        kinds = self.table[points]
        new = np.unique(points[kinds == self.UNKNOWN])
        if len(new) == 0:
            return kinds
        # Set before a digit, a character shows by where pretokens begin after a letter and after a mark.
        begins = {}
        for before in "a!":
            text = "".join(f"{before}{chr(c)}1" for c in new.tolist())
            mark = np.zeros(len(text), bool)
            mark[[span[0] for _, span in self.split.pre_tokenize_str(text)]] = True
            begins[before] = mark.reshape(-1, 3)
        kind = np.full(len(new), 3, np.uint8)
        kind[~begins["!"][:, 1]] = OTHER
        kind[~begins["a"][:, 1]] = LETTER
        kind[begins["a"][:, 1] & ~begins["a"][:, 2]] = NUMBER
        self.table[new] = kind
        return self.table[points]


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and the byte each begins at."""
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    first = raw[lead]
    value = first.astype(np.int32)
    wide = np.flatnonzero(first >= 0xC0)
    if len(wide):
        padded = np.append(raw, np.zeros(3, np.uint8))
        at, b0 = lead[wide], first[wide].astype(np.int32)
        b1, b2, b3 = (padded[at + k].astype(np.int32) & 0x3F for k in (1, 2, 3))
        two = (b0 & 0x1F) << 6 | b1
        three = (b0 & 0x0F) << 12 | b1 << 6 | b2
        four = (b0 & 0x07) << 18 | b1 << 12 | b2 << 6 | b3
        value[wide] = np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, four))
    return value, lead


def symbols(points: np.ndarray, first: np.ndarray, classes: CharacterClasses) -> np.ndarray:
    """Input symbols of the pretoken machine; ``first`` marks first characters of texts."""
    n = len(points)
    kind = classes.of(points)
    last = np.append(first[1:], True)
    white = kind == 3
    ahead = np.append(~white[1:], False) & ~last  # a non-space follows in the same text
    out = kind.copy()
    out[white] = BLANK
    out[white & ahead] = LONE
    out[white & ahead & (points == 0x20)] = SPACE
    tick = np.flatnonzero((points == 0x27) & ~last)
    if len(tick):
        padded = np.append(points, [0, 0])
        next1, next2 = padded[tick + 1], padded[tick + 2]
        two = ~np.append(last, [True, True])[tick + 1]
        out[tick[np.isin(next1, [ord(c) for c in "stmd"])]] = SHORT1
        pair = np.zeros(len(tick), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (next1 == ord(a)) & (next2 == ord(b))
        out[tick[pair & two]] = SHORT2
    out[first] += FIRST
    return out[:n]


def entry_states(maps: np.ndarray) -> np.ndarray:
    """State in which each chunk is entered, from the chunks' state maps, by prefix scan.

    The scan doubles its reach: after round k, row i is the composed map of chunks
    i-2^k+1 .. i.
    """
    scan, reach = maps.copy(), 1
    while reach < len(scan):
        scan[reach:] = np.take_along_axis(scan[reach:], scan[:-reach].copy(), axis=1)
        reach *= 2
    return np.append(np.uint8(CLOSED), scan[:-1, CLOSED])


def pretoken_starts(symbol: np.ndarray) -> np.ndarray:
    """Characters that begin a pretoken."""
    n = len(symbol)
    if n == 0:
        return np.zeros(0, np.int64)
    chunks = -(-n // CHUNK)
    grid = np.full(chunks * CHUNK, BLANK, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
    table, flat = TO.ravel(), BEGINS.ravel()
    maps = np.tile(np.arange(8, dtype=np.uint8), (chunks, 1))
    for row in grid:
        maps = table[maps * np.uint8(16) + row[:, None]]
    state = entry_states(maps)
    begins = np.empty((CHUNK, chunks), bool)
    for k, row in enumerate(grid):
        at = state * np.uint8(16) + row
        begins[k] = flat[at]
        state = table[at]
    return np.flatnonzero(begins.T.ravel()[:n])


class TokenCounter:
    """The lazily compiled transducer from the bytes of a pretoken to its number of tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.prefixes = {t[:k] for t in ranks for k in range(len(t))}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.states: dict[tuple, int] = {}
        self.windows: list[tuple] = []
        self.edges = 0
        self._grow(1 << 12)
        # No last token before the first byte.
        self.root = self._state(b"", ((None, 0),))

    def _grow(self, size: int) -> None:
        old = getattr(self, "keys", None)
        moved = (self.keys, self.next, self.delta) if old is not None else None
        self.keys = np.full(size, -1, np.int64)
        self.next = np.zeros(size, np.int32)
        self.delta = np.zeros(size, np.int16)
        if moved is not None:
            used = moved[0] >= 0
            for key, to, delta in zip(*(x[used].tolist() for x in moved), strict=True):
                self._put(key, to, delta)

    @staticmethod
    def _home(keys, size: int):
        return (keys ^ (keys >> 11)) * 0x9E3779B1 % size

    def _put(self, key: int, to: int, delta: int) -> None:
        size = len(self.keys)
        slot = self._home(key, size)
        while self.keys[slot] >= 0:
            slot = (slot + 1) % size
        self.keys[slot], self.next[slot], self.delta[slot] = key, to, delta

    def _state(self, tail: bytes, window: tuple) -> int:
        found = self.states.get((tail, window))
        if found is None:
            found = self.states[tail, window] = len(self.windows)
            self.windows.append((tail, window))
        return found

    def _merged(self, piece: bytes) -> list[bytes]:
        """Byte-pair merging as the vocabulary defines it: the lowest rank first."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 30), k) for k in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, before: bytes | None, token: bytes) -> bool:
        if before is None:
            return self._may_follow(b"", token)
        known = self.pairs.get((before, token))
        if known is None:
            known = self._merged(before + token) == ([before, token] if before else [token])
            self.pairs[before, token] = known
        return known

    def _compile(self, key: int) -> tuple[int, int]:
        """Next state and change in tokens for ``state << 8 | byte``."""
        tail, window = self.windows[key >> 8]
        text = tail + bytes([key & 255])
        for k in range(len(text)):
            token = text[k:]
            if token in self.ranks and self._may_follow(window[k][0], token):
                delta = window[k][1] + 1
                break
        else:
            raise ValueError("the vocabulary lacks single bytes")
        window = (*window, (token, delta))
        keep = next(k for k in range(len(text) + 1) if text[k:] in self.prefixes)
        return self._state(text[keep:], tuple((t, n - delta) for t, n in window[keep:])), delta

    def _find(self, keys: np.ndarray) -> np.ndarray:
        size = len(self.keys)
        slot = self._home(keys, size)
        open_ = np.flatnonzero(self.keys[slot] != keys)
        while len(open_):
            at = self.keys[slot[open_]]
            open_ = open_[at >= 0]
            slot[open_] = (slot[open_] + 1) % size
            open_ = open_[self.keys[slot[open_]] != keys[open_]]
        return slot

    def _steps(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = self._find(keys)
        new = np.unique(keys[self.keys[slot] != keys])
        if len(new):
            while 2 * (self.edges + len(new)) > len(self.keys):
                self._grow(2 * len(self.keys))
            for key in new.tolist():
                self._put(key, *self._compile(key))
            self.edges += len(new)
            slot = self._find(keys)
        return self.next[slot], self.delta[slot]

    def counts(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each byte span, all spans run in step."""
        out = np.zeros(len(starts), np.int64)
        order = np.argsort(starts - ends, kind="stable")  # the longest first, so the running ones lead
        at, left = starts[order], (ends - starts)[order]
        state = np.full(len(starts), self.root, np.int64)
        total = np.zeros(len(starts), np.int64)
        step, n = 0, len(starts)
        while n:
            n = int(np.searchsorted(-left, -step, "left"))  # those longer than step
            if not n:
                break
            state[:n], delta = self._steps(state[:n] << 8 | raw[at[:n] + step])
            total[:n] += delta
            step += 1
        out[order] = total
        return out


@lru_cache(maxsize=2)
def _compiled(json_path: str, ranks_path: str) -> tuple[CharacterClasses, TokenCounter]:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return CharacterClasses(json_path), TokenCounter(ranks)


def compiled(json_path: str, ranks_path: str) -> tuple[CharacterClasses, TokenCounter]:
    """The worker's transducers; they start anew once they hold ``MOST_STATES`` states."""
    if len(_compiled(json_path, ranks_path)[1].windows) > MOST_STATES:
        _compiled.cache_clear()
    return _compiled(json_path, ranks_path)


def count_texts(texts: pa.Array, classes: CharacterClasses, machine: TokenCounter) -> np.ndarray:
    """Tokens of each text; a null counts as empty, the special string as one token."""
    rows = np.arange(len(texts))
    extra = np.zeros(len(texts), np.int64)
    if pc.any(pc.match_substring(texts, SPECIAL)).as_py():
        parts = [(text or "").split(SPECIAL) for text in texts.to_pylist()]
        extra = np.array([len(p) - 1 for p in parts], np.int64)
        rows = np.repeat(rows, extra + 1)
        texts = pa.array([x for p in parts for x in p], pa.string())
    raw, offsets = frames.text_bytes(texts)
    points, lead = code_points(raw)
    first = np.zeros(len(points), bool)
    begin = np.searchsorted(lead, offsets[:-1][offsets[1:] > offsets[:-1]])
    first[begin] = True
    at = lead[pretoken_starts(symbols(points, first, classes))]
    ends = np.append(at[1:], len(raw))[: len(at)]
    counts = machine.counts(raw, at, ends)
    owner = rows[np.searchsorted(offsets, at, "right") - 1]
    return np.bincount(owner, weights=counts, minlength=len(extra)).astype(np.int64) + extra


def token_counts(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs(doc_id, text, ...)``.

    The counts are those of the library for the vocabulary at ``json_path``, without added
    tokens; ``ranks_path`` holds the same vocabulary as ranks. A null or empty text has 0 bytes
    and 0 tokens. Repeated rows and null ids are counted like others. Other columns are
    ignored. An empty table gives an empty result.
    """
    import public_tokenizers

    json_path = json_path or str(public_tokenizers.path("byte_bpe_50k.json"))
    ranks_path = ranks_path or str(public_tokenizers.path("byte_bpe_50k.tiktoken"))

    def run(batches):
        for batch in batches:
            for part in frames.text_slices(batch, "text"):
                classes, machine = compiled(json_path, ranks_path)
                texts = part.column("text")
                n = count_texts(texts, classes, machine)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(frames.offsets_of(texts))), pa.array(n), pa.array(n > TOKEN_LIMIT)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
