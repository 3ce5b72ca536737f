"""Byte-pair encoding by dynamic programming over the prefixes of a word, and decoding.

Every prefix of a word has one encoding, so one last token.  An automaton with
suffix links reads the word's bytes and names the vocabulary entries that end at
each of them, longest first.  An entry is the last token of the prefix if it may
follow the last token of the prefix before it: no merge that comes earlier than
those inside the two reaches over their boundary.  The last token of each prefix
is stored; from the word's end the stored tokens lead back to its start, which
gives the exact ids in time proportional to the word, however long it is.

A pair of tokens is tested on their edges: the symbols that stand left and right
of the boundary while both are built up, each from its own merge until the merge
that consumes it.  That needs merges whose parts are made by earlier ones, which
is checked when the file is read.
"""
from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, byte_view, row_slices, table, text_pieces, worker_state
from .tokenids import spans, tokenizer_path
from .transducer import WHITE, WORD_END, byte_symbols

#: distinct words and tested pairs that a task keeps; both start anew beyond it
WORDS, PAIRS = 300_000, 600_000
#: words encoded at a time
BLOCK = 200_000
LAST = 1 << 40
_SPACE = "".join(map(chr, WHITE))
#: fixed value: how the tokenizer's splitter parts lower-cased text
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Vocabulary:
    """Tokens, merges and the automaton of one tokenizer file.

    A symbol is a byte, or a byte plus 256 if it ends its word; a token is
    written as the characters of its symbols' numbers.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        if (model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END or spec["decoder"] is not None
                or [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]
                or split[0]["pattern"] != {"Regex": SPLIT} or split[1]["type"] != "ByteLevel"):
            raise ValueError("only word-end byte-pair encoding over lower-cased NFC text without a decoder is supported")
        self.shown = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        symbols = byte_symbols()

        def written(token: str) -> str:
            last = token.endswith(WORD_END) and len(token) > len(WORD_END)
            plain = [symbols[c] for c in (token[:-len(WORD_END)] if last else token)]
            return "".join(map(chr, plain[:-1])) + chr(plain[-1] + 256 * last)

        self.ids = {written(t): i for t, i in model["vocab"].items() if t not in self.special}
        if any(chr(s) not in self.ids for s in range(512)):
            raise ValueError("the vocabulary lacks a byte")
        self.size = max(self.shown) + 1
        self.length = array("q", [0] * self.size)
        for text, i in self.ids.items():
            self.length[i] = len(text)
        self.merges: dict[int, int] = {}
        #: when a token is made, and of what
        self.made, self.parts = [-1] * self.size, [None] * self.size
        for rank, (a, b) in enumerate(model["merges"]):
            a, b, whole = (self.ids[written(t)] for t in (a, b, a + b))
            if any(self.length[t] > 1 and not self.parts[t] for t in (a, b)) or self.parts[whole]:
                raise ValueError("a merge joins what no earlier merge makes, or makes what another makes")
            self.merges[a * self.size + b] = rank
            self.made[whole], self.parts[whole] = rank, (a, b)
        # entries that byte-pair encoding never leaves whole are no tokens
        self.whole = [True] * self.size
        for token in sorted(self.ids.values(), key=self.made.__getitem__):
            if self.parts[token]:
                a, b = self.parts[token]
                self.whole[token] = self.whole[a] and self.whole[b] and self.may_follow(a, b, self.made[token])
            else:
                self.whole[token] = self.length[token] == 1
        import ahocorasick
        self.matches = ahocorasick.Automaton()
        for text, i in self.ids.items():
            if self.whole[i]:
                self.matches.add_word(text, i)
        self.matches.make_automaton()

    def may_follow(self, a: int, b: int, before: int = LAST) -> bool:
        """Whether no merge earlier than `before` reaches over the boundary of the tokens a and b.

        Goes back in time: the younger edge is taken apart, until both are single symbols.
        A merge over the boundary is too late once the left edge is consumed; of two equal
        merges in one run of symbols the left one comes first, so the right edge is still there.
        """
        made, merges, size = self.made, self.merges, self.size
        left = right = before
        while True:
            rank = merges.get(a * size + b)
            if rank is not None and rank < left and rank <= right and rank < before:
                return False
            if made[a] < 0 and made[b] < 0:
                return True
            if made[a] > made[b]:
                left, a = made[a], self.parts[a][1]
            else:
                right, b = made[b], self.parts[b][0]


class Encoder:
    """Token ids of texts; words already met are looked up."""

    def __init__(self, path: str):
        self.vocabulary = worker_state(f"prefixbpe {path}", lambda: Vocabulary(path))
        self.word = regex.compile(SPLIT.replace(r"\s", regex.escape(_SPACE)))
        special = sorted(map(re.escape, self.vocabulary.special), key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(special)})") if special else None
        self.pairs: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.number = {s: n for n, s in enumerate(self.vocabulary.special)}
        self.ids = array("i", self.vocabulary.special.values())
        self.start = array("q", range(len(self.ids)))
        self.count = array("q", [1] * len(self.ids))

    def words(self, text: str) -> list[str]:
        """The words of a text in normal form, special strings among them."""
        if self.special and self.special.search(text):
            out = []
            for n, part in enumerate(self.special.split(text)):
                out += [part] if n % 2 else self.plain_words(part)
            return out
        return self.plain_words(text)

    def plain_words(self, text: str) -> list[str]:
        if not text.isascii():
            # a capital sigma has one small form here, wherever it stands
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.word.findall(text.lower())

    def encoded(self, word: str) -> list[int]:
        """Ids of one word: the last token of every prefix, then back from the end."""
        own = self.vocabulary
        length, pairs, size = own.length, self.pairs, own.size
        symbols = word.encode().decode("latin-1")
        symbols = symbols[:-1] + chr(ord(symbols[-1]) + 256)
        last = array("i", [-1]) * len(symbols)
        for end, token in own.matches.iter(symbols):
            if last[end] < 0:
                at = end - length[token]
                if at >= 0:
                    pair = last[at] * size + token
                    good = pairs.get(pair)
                    if good is None:
                        if len(pairs) > PAIRS:
                            pairs.clear()
                        good = pairs[pair] = own.may_follow(last[at], token)
                    if not good:
                        continue
                last[end] = token
        out, end = [], len(symbols) - 1
        while end >= 0:
            out.append(last[end])
            end -= length[last[end]]
        out.reverse()
        return out

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        if len(self.count) > WORDS:
            self.forget()
        number = self.number
        for word in set(words).difference(number):
            ids = self.encoded(word)
            number[word] = len(self.count)
            self.start.append(len(self.ids))
            self.count.append(len(ids))
            self.ids.extend(ids)
        at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        count = np.array(self.count, np.int64)[at]
        return np.array(self.ids, np.int32)[spans(np.array(self.start, np.int64)[at], count)], count

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each).

        A long text is split into words piece by piece, cut at white space, which no word holds.
        """
        total, out = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)]
        words: list[str] = []
        owners: list[tuple[int, int]] = []

        def flush() -> None:
            ids, count = self.lookup(words)
            out.append(ids)
            at = 0
            for text, n in owners:
                total[text] += count[at:at + n].sum()
                at += n
            words.clear()
            owners.clear()

        for n, text in enumerate(texts):
            for piece in text_pieces(text, SLICE_BYTES):
                found = self.words(piece.decode())
                owners.append((n, len(found)))
                words += found
                if len(words) > BLOCK:
                    flush()
        flush()
        return np.concatenate(out), total


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row and its whole text.

    Special strings inside a text become their ids, nothing is added, cut or
    padded.  A null or empty text has no ids.  Null ids and repeated rows are
    kept; other columns are not read.
    """
    def run(batches):
        encoder = Encoder(tokenizer)
        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            view = memoryview(data)
            for low, high in row_slices(offsets):
                ids, size = encoder([bytes(view[a:b]) for a, b in zip(offsets[low:high], offsets[low + 1:high + 1])])
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(size)].astype(np.int32), ids)
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], lists], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(coded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text) for every row: the tokens as the vocabulary writes them, joined by one space.

    That is the text of a tokenizer without a decoder, special tokens included.
    No or null ids give an empty text, ids outside the vocabulary nothing.
    """
    def run(batches):
        shown = worker_state(f"prefixbpe {tokenizer}", lambda: Vocabulary(tokenizer)).shown
        for batch in batches:
            lists = batch.column(1)
            offsets = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            for low, high in row_slices(4 * offsets):
                texts = [" ".join([shown[i] for i in ids[a:b].tolist() if i in shown])
                         for a, b in zip(offsets[low:high], offsets[low + 1:high + 1])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], lists[low:high], pa.array(texts, pa.string())],
                                                 names=[id_col, "ids", "text"])

    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(id_col, F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, text string")


def op11_prefixbpe(spark, sf_dir) -> DataFrame:
    tokenizer = tokenizer_path()
    coded = encode(table(spark, sf_dir, "documents"), tokenizer)
    return decode(coded, tokenizer).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {"op11_prefixbpe": (op11_prefixbpe, None)}
