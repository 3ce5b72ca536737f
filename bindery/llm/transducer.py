"""Token counts by a finite-state tokenizer.

Byte-pair encoding with word ends is compiled into a deterministic transducer
over bytes.  A state holds, for every start of an unfinished token (a suffix that
some vocabulary entry begins with), the token before it and its count relative
to the current position.  Appending a byte ends exactly one token that is
admissible after the token before it; the transition is annotated with the
change of the token count and may be negative, as a longer token takes the place
of several.  A word's last byte leads back to the start state.  That a pair of
tokens is admissible (the merges leave both as they are) decides whole words,
because merges reach only from one token to the next.  States are made when a
text first needs them and forgotten beyond a bound, as in a lazy automaton.

Texts are cut into chunks of equal length that advance together.  From a chunk's
first word end on its state map is constant; a scan over the chunks brings each
open head the state before it, and chunks inside one long word are composed one
after the other.
"""
from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_view, row_slices, table
from .tokenids import tokenizer_path

CHUNK = 256
#: states kept; about 1.5 kB each
STATES = 120_000
#: texts that the driver compiles the first states from, and bytes of each
WARM_TEXTS, WARM_BYTES = 500, 4_000
LIMIT = 2048
SPACE, LETTER, NUMBER, OTHER = range(4)
#: fixed values: endings that an apostrophe splits off
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: fixed value: the mark of a word's last symbol in the vocabulary
WORD_END = "</w>"
#: fixed values: code points that the white-space class holds
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Machine:
    """The transducer of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        model = spec["model"]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END:
            raise ValueError("only word-end byte-pair encoding over lower-cased NFC text is compiled")
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        symbols = byte_symbols()

        def key(token):
            last = token.endswith(WORD_END) and len(token) > len(WORD_END)
            return bytes(symbols[c] for c in (token[:-len(WORD_END)] if last else token)), last

        specials = {t["content"] for t in spec["added_tokens"]}
        self.ids = {key(t): i for t, i in model["vocab"].items() if t not in specials}
        self.text = {i: k for k, i in self.ids.items()}
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[self.ids[key(a)], self.ids[key(b)]] = rank, self.ids[key(a + b)]
        self.open = {word[:n] for word, _ in self.ids for n in range(len(word))}
        self.admitted: dict[tuple, bool] = {}
        self.forget()

    def forget(self) -> None:
        """Back to the start state alone: column 0 skips, others are made when a symbol is first seen."""
        self.states = [(b"", ((0, -1, 0),))]
        self.number = {self.states[0]: 0}
        self.column = np.full(513, -1, np.int64)
        self.column[512] = 0
        self.symbols = [512]
        self.width = 64
        self.next = np.full(1024 * self.width, -1, np.int32)
        self.emit = np.zeros(1024 * self.width, np.int8)
        self.next[::self.width] = 0

    def merged(self, ids: list[int]) -> list[int]:
        while True:
            ranked = [(self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
            if not ranked:
                return ids
            _, i = min(ranked)
            ids = ids[:i] + [self.merges[ids[i], ids[i + 1]][1]] + ids[i + 2:]

    def single(self, token: int) -> list[int]:
        word, last = self.text[token]
        return [self.ids[word[i:i + 1], last and i == len(word) - 1] for i in range(len(word))]

    def admissible(self, before: int, token: int) -> bool:
        known = self.admitted.get((before, token))
        if known is None:
            want = [token] if before < 0 else [before, token]
            known = self.merged([s for t in want for s in self.single(t)]) == want
            self.admitted[before, token] = known
        return known

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, change of the token count) for a byte, plus 256 if it ends its word."""
        word, starts = self.states[state]
        byte, last = bytes([symbol & 255]), symbol >= 256
        for length, before, count in starts:
            token = self.ids.get((word[len(word) - length:] + byte, last))
            if token is not None and self.admissible(before, token):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        if last:
            return 0, count + 1
        grown = [(n + 1, b, c - count - 1) for n, b, c in starts if word[len(word) - n:] + byte in self.open]
        longest = max((n for n, _, _ in grown), default=0)
        new = ((word + byte)[len(word) + 1 - longest:], (*grown, (0, token, 0)))
        at = self.number.get(new)
        if at is None:
            at = self.number[new] = len(self.states)
            self.states.append(new)
            if len(self.states) * self.width > len(self.next):
                self.next = np.r_[self.next, np.full(len(self.next), -1, np.int32)]
                self.emit = np.r_[self.emit, np.zeros(len(self.emit), np.int8)]
                self.next[::self.width] = 0
        return at, count + 1

    def columns(self, symbols: np.ndarray) -> np.ndarray:
        """Table columns of symbols; new ones get a column."""
        for s in np.flatnonzero((np.bincount(symbols, minlength=513) > 0) & (self.column < 0)):
            self.column[s] = len(self.symbols)
            self.symbols.append(int(s))
        if len(self.symbols) > self.width:
            old, self.width = self.width, max(2 * self.width, len(self.symbols))
            self.next, self.emit = (
                np.pad(t.reshape(-1, old), ((0, 0), (0, self.width - old)), constant_values=v).reshape(-1)
                for t, v in ((self.next, -1), (self.emit, 0)))
        return self.column[symbols]

    def advance(self, state: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = state * self.width + column
        to = self.next[at]
        if (to < 0).any():
            for cell in np.unique(at[to < 0]).tolist():
                target, change = self.step(cell // self.width, self.symbols[cell % self.width])
                self.next[cell], self.emit[cell] = target, change
            to = self.next[at]
        return to.astype(np.int64), self.emit[at]

    def changes(self, symbols: np.ndarray) -> np.ndarray:
        """Change of the token count at each symbol of a sequence that starts and ends between words."""
        if len(self.states) > STATES:
            self.forget()
        n = len(symbols)
        chunks = -(-n // CHUNK)
        column = np.zeros(chunks * CHUNK, np.int64)
        column[:n] = self.columns(symbols)
        column = column.reshape(chunks, CHUNK)
        out = np.zeros((chunks, CHUNK), np.int8)
        free = np.zeros(chunks * CHUNK, bool)
        free[:n] = symbols >= 256
        free[n:] = True
        free = free.reshape(chunks, CHUNK)
        # symbols up to the first word end (or skipped byte) are the head; the first chunk has none
        head = np.where(free.any(axis=1), free.argmax(axis=1) + 1, CHUNK)
        head[0] = 0
        constant = free.any(axis=1)
        constant[0] = True
        tail = np.where(np.arange(CHUNK) < head[:, None], 0, column).T.copy()
        state = np.zeros(chunks, np.int64)
        kept = np.zeros((CHUNK, chunks), np.int8)
        for j in range(CHUNK):
            state, kept[j] = self.advance(state, tail[j])
        out += kept.T
        # the scan: a chunk's head is run once the state before it is known
        known = constant.copy()
        waiting = head > 0
        while waiting.any():
            ready = np.flatnonzero(waiting & np.r_[False, known[:-1]])
            now, j = state[ready - 1], 0
            lanes = ready
            while len(lanes):
                now, out[lanes, j] = self.advance(now, column[lanes, j])
                j += 1
                ended = head[lanes] == j
                opened = ended & ~constant[lanes]
                state[lanes[opened]] = now[opened]
                lanes, now = lanes[~ended], now[~ended]
            known[ready] = True
            waiting[ready] = False
        return out.reshape(-1)[:n]


def char_tables() -> tuple[np.ndarray, np.ndarray]:
    """(class, lower case) of every code point; U+0130, which becomes two, is left to the caller."""
    kind = np.full(0x110000, OTHER, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for code in range(0x110000):
        c = chr(code)
        group = unicodedata.category(c)[0]
        if group in "LN":
            kind[code] = LETTER if group == "L" else NUMBER
            small = c.lower()
            if len(small) == 1:
                lower[code] = ord(small)
        elif group == "S" or group == "M":
            small = c.lower()
            if len(small) == 1:
                lower[code] = ord(small)
    kind[WHITE] = SPACE
    return kind, lower


class Counter:
    """Token counts of texts."""

    def __init__(self, machine: Machine, tables: tuple[np.ndarray, np.ndarray]):
        self.machine, (self.kind, self.lower) = machine, tables
        self.special = re.compile(b"|".join(map(re.escape, sorted(machine.special, key=len, reverse=True))))

    def plain(self, text: bytes) -> tuple[str, int]:
        """A text in normal form without its special strings, and how many those are."""
        extra = 0
        if b"<" in text:
            text, extra = self.special.subn(b" ", text) if self.machine.special else (text, 0)
        out = text.decode()
        if not out.isascii():
            if not unicodedata.is_normalized("NFC", out):
                out = unicodedata.normalize("NFC", out)
            out = out.replace("İ", "i̇")
        return out, extra

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0, np.int64)
        pairs = [self.plain(t) for t in texts]
        total = np.array([extra for _, extra in pairs], np.int64)
        # a space after each text keeps words apart
        size = np.array([len(t) + 1 for t, _ in pairs])
        code = np.frombuffer((" ".join(t for t, _ in pairs) + " ").encode("utf-32-le"), "<u4")
        kind, code = self.kind[code], self.lower[code]
        end = self.word_ends(kind, code)
        wide = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        place = np.cumsum(wide)
        symbols = np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8).astype(np.int64)
        symbols[place[end] - 1] += 256
        symbols[place[kind == SPACE] - 1] = 512
        for n in (2, 3):  # white space of several bytes
            at = place[(kind == SPACE) & (wide >= n)] - n
            symbols[at] = 512
        change = np.cumsum(self.machine.changes(symbols), dtype=np.int64)
        return total + np.diff(np.r_[0, change[place[np.cumsum(size) - 1] - 1]])

    @staticmethod
    def word_ends(kind: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Where the splitter ends a word: runs of letters, of other characters, single digits, endings after '."""
        after = np.r_[kind[1:], SPACE]
        end = (kind == NUMBER) | ((kind == LETTER) & (after != LETTER)) | ((kind == OTHER) & (after != OTHER))
        first = np.r_[True, kind[:-1] != OTHER]
        at = np.flatnonzero((code == ord("'")) & first & (after == LETTER))
        for ending in ENDINGS:
            hit = at[at + len(ending) < len(code)]
            for i, c in enumerate(ending, 1):
                hit = hit[code[hit + i] == ord(c)]
            end[hit] = False
            end[hit + len(ending)] = True
        return end


def warmed(machine: Machine, tables, docs: DataFrame, text_col: str) -> Machine:
    """The machine with the states of a bounded sample of texts."""
    rows = docs.select(F.substring(text_col, 1, WARM_BYTES).alias("t")).where("t is not null").limit(WARM_TEXTS)
    Counter(machine, tables)([r.t.encode() for r in rows.collect()])
    return machine


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) for every row and its whole text.

    A null text counts as empty: no bytes, no tokens.  The sample that the first
    states come from decides only how soon a task has the states it needs.
    Repeated rows are counted one by one; other columns are not read.
    """
    spark = docs.sparkSession
    tables = char_tables()
    shared = spark.sparkContext.broadcast((warmed(Machine(tokenizer), tables, docs, text_col), tables))

    def run(batches):
        machine, own = shared.value
        counter = Counter(machine, own)
        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            view, counts = memoryview(data), [np.zeros(0, np.int64)]
            for low, high in row_slices(offsets, 1 << 21):
                counts.append(counter([bytes(view[a:b]) for a, b in zip(offsets[low:high], offsets[low + 1:high + 1])]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(np.concatenate(counts))],
                names=[id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")


def op6_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op6_transducer": (op6_transducer, None)}
