"""Token counts by compiled finite-state transducers, without building the tokens.

Two deterministic transducers count what a byte-level BPE tokenizer file would give.

The first reads character classes and says where a match of the splitting pattern begins. It has thirteen
states, so a chunk of text is a map from entry state to exit state. All chunks of a slice are walked side by
side for every entry state, the maps are composed by a parallel prefix scan, and with the entry state of each
chunk known a second walk writes the beginnings.

The second reads the bytes of one match. After every prefix its state holds the longest suffix that can still
grow into a longer token, and for each place where such a token may begin the last token of the encoding up to
there and the number of tokens relative to now. The next byte decides the new last token: of the tokens that
end there exactly one stands in a lasting pair with the token before it. Each transition is annotated with the
change of the token count, which is negative when tokens merge. Transitions are compiled when they are first
met and kept in a hash table. At a beginning the second transducer starts anew, so its map over a chunk is
constant there and only the first transducer's maps need the scan.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.llm.common import documents, map_arrow, narrow, slices

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LIMIT = 1024
CHUNK = 512                # characters of a chunk whose state map is computed
WIDTH = 48                 # bytes of a match that are walked side by side with those of others
KEPT_TRANSITIONS = 400_000  # compiled transitions kept between blocks; beyond it compilation starts anew
BLOCK_BYTES = 1 << 19

# classes of characters; the letters are those that contractions are made of
SPACE, WHITE, LETTER, NUMBER, SYMBOL, QUOTE, STMD, R, V, L, E, END = range(12)
CLASSES = 12
LETTERS = (LETTER, STMD, R, V, L, E)
# states: what the match that is being read consists of
START, WORD, DIGITS, SYMBOLS, QUOTED, QUOTE_R, QUOTE_V, QUOTE_L, DONE, ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE = range(13)
STATES = 13


def _fresh(c: int) -> int:
    if c in LETTERS:
        return WORD
    return {SPACE: ONE_SPACE, WHITE: ONE_WHITE, NUMBER: DIGITS, SYMBOL: SYMBOLS, QUOTE: QUOTED, END: START}[c]


def _step(state: int, c: int) -> tuple[int, bool, bool]:
    """Next state, whether a match begins at this character, and whether one began at the one before."""
    fresh = _fresh(c)
    if state in (START, DONE):
        return fresh, True, False
    if state == WORD:
        return (WORD, False, False) if c in LETTERS else (fresh, True, False)
    if state == DIGITS:
        return (DIGITS, False, False) if c == NUMBER else (fresh, True, False)
    if state == SYMBOLS or state == QUOTED and c in (SYMBOL, QUOTE):
        return (SYMBOLS, False, False) if c in (SYMBOL, QUOTE) else (fresh, True, False)
    if state == QUOTED:
        after = {STMD: DONE, R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}
        return (after[c], False, False) if c in after else (fresh, True, False)
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):
        if c == (L if state == QUOTE_L else E):
            return DONE, False, False
        return (WORD, False, True) if c in LETTERS else (fresh, True, True)
    if c in (SPACE, WHITE):  # white space: the last character of a run belongs to what follows, if it is a space
        return (MORE_SPACE if c == SPACE else MORE_WHITE), False, False
    run = state in (MORE_SPACE, MORE_WHITE)
    if c == END:
        return START, True, False
    if state in (ONE_SPACE, MORE_SPACE):
        return (SYMBOLS if c in (SYMBOL, QUOTE) else fresh), False, run
    return fresh, True, run


_STEPS = [[_step(s, c) for c in range(CLASSES)] for s in range(STATES)]
NEXT = np.array([[x[0] for x in row] for row in _STEPS], np.uint8).ravel()
BEGINS = np.array([[x[1] + 2 * x[2] for x in row] for row in _STEPS], np.uint8).ravel()


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point, as the library's own expression engine sees it."""
    code_points = [*range(0xD800), *range(0xE000, 0x110000)]
    everything = "".join(map(chr, code_points))
    where = np.array(code_points)
    out = np.full(0x110000, SYMBOL, np.uint8)
    for name, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(name), "removed")
        inside = np.ones(len(where), bool)
        for _, (start, stop) in split.pre_tokenize_str(everything):
            inside[start:stop] = False
        out[where[inside]] = kind
    for letters, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        out[[ord(x) for x in letters]] = kind
    return out


def beginnings(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Places where a match begins, and the places of all ends of text, in ascending order."""
    n = -(-len(classes) // chunk)
    columns = np.full((n, chunk), END, np.uint8)
    columns.ravel()[:len(classes)] = classes
    columns = np.ascontiguousarray(columns.T)
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (n, 1))
    for column in columns:
        maps = NEXT[maps.astype(np.int16) * CLASSES + column[:, None]]
    distance = 1
    while distance < n:  # after each round a map covers twice as many chunks
        maps = np.concatenate([maps[:distance], np.take_along_axis(maps[distance:], maps[:-distance].astype(np.int64), 1)])
        distance *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.int16)
    found = np.empty((chunk, n), np.uint8)
    for k, column in enumerate(columns):
        at = state * CLASSES + column
        found[k] = BEGINS[at]
        state = NEXT[at].astype(np.int16)
    flat = np.ascontiguousarray(found.T).ravel()[:len(classes)]
    begins = (flat & 1).astype(bool)
    begins[:-1] |= (flat[1:] & 2).astype(bool)
    return np.flatnonzero(begins)


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in the file: visible Latin-1 for themselves, the others from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Rules:
    """Tokens and merges of a byte-level BPE file, and which tokens may stand side by side for good."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as lines:
            content = json.load(lines)
        letters = _byte_letters()
        raw = {name: bytes(letters[x] for x in name) for name in content["model"]["vocab"]}
        ids = content["model"]["vocab"]
        self.tokens = {raw[name]: number for name, number in ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(content["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = ids[left], ids[right]
            self.rank.setdefault(pair, rank)
            self.parts.setdefault(ids[left + right], pair)
        self.growing = {token[:k] for token in self.tokens for k in range(1, len(token))}
        self.special = [x["content"] for x in content["added_tokens"]]
        self._edges: tuple[dict, dict] = ({}, {})
        self._lasting: dict[tuple[int, int], bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens at one edge of a token while it is merged, each with the rank at which it disappears."""
        known = self._edges[side].get(token)
        if known is None:
            known = [(token, float("inf"))]
            while (pair := self.parts.get(known[-1][0])) is not None:
                known.append((pair[side], self.rank[pair]))
            known.reverse()
            self._edges[side][token] = known
        return known

    def lasting(self, left: int, right: int) -> bool:
        """Whether no merge ever reaches over the border between both tokens."""
        known = self._lasting.get((left, right))
        if known is None:
            a, b = self._edge(left, 1), self._edge(right, 0)
            i = j = 0
            while True:
                (x, x_ends), (y, y_ends) = a[i], b[j]
                over = self.rank.get((x, y), float("inf"))
                if over < x_ends and over <= y_ends:  # of equal ranks the leftmost merge comes first
                    known = over == float("inf")
                    break
                if x_ends == y_ends == float("inf"):
                    known = True
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            if len(self._lasting) > 2_000_000:
                self._lasting.clear()
            self._lasting[left, right] = known
        return known


_NONE = -1  # before the first token
_UNUSED = -2


class Counter:
    """The transducer over bytes of one match, compiled as far as it was needed."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules
        self.clear()

    def clear(self) -> None:
        root = (b"", (_NONE,), (0,))
        self.states = [root]
        self.numbers = {root: 0}
        self.known: dict[int, int] = {}  # state * 256 + byte to next state * 256 + change + 128
        self._slots(1 << 20)

    def _slots(self, size: int) -> None:
        self.keys = np.full(size, -1, np.int64)
        self.values = np.zeros(size, np.int64)
        if self.known:
            self._put(np.fromiter(self.known, np.int64, len(self.known)), np.fromiter(self.known.values(), np.int64, len(self.known)))

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * 0x9E3779B1) >> 11) & (len(self.keys) - 1)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = self._hash(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays
            placed = self.keys[at] == keys
            self.values[at[placed]] = values[placed]
            left = ~placed
            keys, values, at = keys[left], values[left], (at[left] + 1) & (len(self.keys) - 1)

    def compiled(self, key: int) -> int:
        """The transition of a state on a byte."""
        known = self.known.get(key)
        if known is not None:
            return known
        rules = self.rules
        suffix, last, ahead = self.states[key >> 8]
        longer = suffix + bytes([key & 255])
        for k in range(len(longer)):
            token = rules.tokens.get(longer[k:])
            if token is not None and last[k] != _UNUSED and (last[k] == _NONE or rules.lasting(last[k], token)):
                break
        change = ahead[k] + 1
        last, ahead = (*last, token), (*[x - change for x in ahead], 0)
        start = 0
        while start < len(longer) and longer[start:] not in rules.growing:
            start += 1
        suffix = longer[start:]
        used = [k == len(longer) or longer[k:] in rules.growing for k in range(start, len(longer) + 1)]
        state = (suffix, tuple(t if u else _UNUSED for t, u in zip(last[start:], used)),
                 tuple(n if u else 0 for n, u in zip(ahead[start:], used)))
        number = self.numbers.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        value = self.known[key] = number * 256 + change + 128
        return value

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Transitions of many states at once; missing ones are compiled."""
        at = self._hash(keys)
        there = self.keys[at]
        out = self.values[at]
        open_ = np.flatnonzero(there != keys)
        while len(open_):
            empty = there[open_] == -1
            if empty.any():
                new = np.unique(keys[open_[empty]])
                values = np.array([self.compiled(int(x)) for x in new], np.int64)
                if 2 * len(self.known) > len(self.keys):
                    self._slots(2 * len(self.keys))
                    return self.look_up(keys)
                self._put(new, values)
                out[open_[empty]] = values[np.searchsorted(new, keys[open_[empty]])]
                open_ = open_[~empty]
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            there[open_] = self.keys[at[open_]]
            out[open_] = self.values[at[open_]]
            open_ = open_[there[open_] != keys[open_]]
        return out

    def _tail(self, state: int, body: bytes) -> int:
        total = 0
        known = self.known
        for byte in body:
            value = known.get(state * 256 + byte)
            if value is None:
                if len(known) > 2 * KEPT_TRANSITIONS:
                    place = self.states[state]
                    self.clear()
                    known = self.known
                    state = self.numbers.setdefault(place, len(self.states))
                    if state == len(self.states):
                        self.states.append(place)
                value = self.compiled(state * 256 + byte)
            state = value >> 8
            total += (value & 255) - 128
        return total

    def counts(self, body: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int = WIDTH) -> np.ndarray:
        """Number of tokens of every match."""
        out = np.zeros(len(starts), np.int64)
        ends = np.cumsum(np.minimum(lengths, width))
        first = 0
        while first < len(starts):
            if len(self.known) > KEPT_TRANSITIONS:
                self.clear()
            before = ends[first] - min(lengths[first], width)
            stop = max(first + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, "right")))
            order = np.argsort(-lengths[first:stop], kind="stable") + first
            begin, size = starts[order], lengths[order]
            state = np.zeros(len(order), np.int64)
            total = np.zeros(len(order), np.int64)
            longer = np.searchsorted(-size, -np.arange(width), "left")  # matches with more than k bytes
            for k in range(width):
                n = longer[k]
                if not n:
                    break
                value = self.look_up(state[:n] * 256 + body[begin[:n] + k])
                state[:n] = value >> 8
                total[:n] += (value & 255) - 128
            places = [self.states[s] for s in state[:np.searchsorted(-size, -width, "left")]]
            for k, place in enumerate(places):
                number = self.numbers.setdefault(place, len(self.states))
                if number == len(self.states):
                    self.states.append(place)
                total[k] += self._tail(number, body[begin[k] + width:begin[k] + size[k]].tobytes())
            out[order] = total
            first = stop
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per worker process; the tokenizer file must lie at the same path on every machine."""
    return Counter(Rules(path))


def token_counts(texts: list[str | None], transducer: Counter, chunk: int = CHUNK) -> np.ndarray:
    """Tokens of every text; a special token's string in a text is that one token."""
    parts: list[str] = []
    owner: list[int] = []
    out = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        pieces = [text or ""]
        for special in transducer.rules.special:
            split = [p.split(special) for p in pieces]
            out[k] += sum(map(len, split)) - len(split)
            pieces = [x for p in split for x in p]
        parts += pieces
        owner += [k] * len(pieces)
    whole = "".join(parts)
    code_points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    body = np.frombuffer(whole.encode(), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    place = np.arange(len(code_points)) + np.repeat(np.arange(len(parts)), sizes)
    classes = np.full(len(code_points) + len(parts), END, np.uint8)
    classes[place] = character_classes()[code_points]
    bytes_of = np.zeros(len(classes), np.int64)
    bytes_of[place] = 1 + (code_points >= 0x80) + (code_points >= 0x800) + (code_points >= 0x10000)
    begins = beginnings(classes, chunk)
    at = (np.cumsum(bytes_of) - bytes_of)[begins]
    lengths = np.diff(np.append(at, len(body)))
    real = classes[begins] != END
    counted = transducer.counts(body, at[real], lengths[real])
    part = np.searchsorted(np.cumsum(sizes + 1), begins[real], "right")
    np.add.at(out, np.asarray(owner, np.int64)[part], counted)
    return out


def _map(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = counter(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                counts = token_counts(texts, transducer)
                sizes = pa.array([len((t or "").encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = TOKENIZER,
                 limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row, as the tokenizer file counts its whole text.

    ``path`` is a byte-level BPE file of the ``tokenizers`` library with its usual splitting pattern. No
    special tokens are added; a special string in a text is one token, the library's default. A null text is
    empty and has no tokens. One pass without a shuffle: repeated rows give repeated results, an empty table
    gives no rows, other columns are not read.
    """
    rows = narrow(df, doc_id=id_column, text=text_column)
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    counted = map_arrow(rows, _map(path), T.StructType([rows.schema["doc_id"], *fields]))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark, sf_dir):
    return count_tokens(documents(spark, sf_dir))


QUERIES = {"op13_token_counts": op13_token_counts}
SQL: dict[str, str] = {}
