"""Token ids of documents in ORC files.

Rows lie in ascending id order over all files: (part, doc_id, local_start,
n_tokens, ids).  `part` numbers the files, `local_start` counts the ids of the
same file before the row.  ORC packs the integers with run-length encoding per
stripe, so stripes are read in parallel; row indexes and Bloom filters on the id
let a look-up skip stripes and row groups.  `layout` gives each file's first
position from the narrow columns alone.

Texts are encoded by the tokenizers library.  It never lets a token span white
space, nor a letter and an ASCII mark, so such pieces are encoded once and cached.
A cached piece is found by hashes and compared byte by byte; texts with a piece
that only looks like a cached one are encoded whole.
"""
from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import stage_dir
from .common import byte_view, row_slices, table, worker_state
from .wordscan import Powers

TOKENIZER = "word_bpe_49k.json"
END = 2
#: distinct pieces, and ids of all of them, that a worker keeps; one slice of texts may exceed them
CACHE, CACHE_IDS = 400_000, 6_000_000
#: ASCII marks but the apostrophe
MARKS = "".join(map(chr, [*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
ORC = {"compression": "zstd", "orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000",
       "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


#: texts that the library may cut elsewhere than between ASCII or Latin-1 letters and other ASCII: apostrophes,
#: possible special strings, characters that are not ASCII nor Latin-1 letters
_UNSURE = re.compile(rb"['\xc2\xc4-\xff]|<\||\xc3[\x97\xb7]")
#: kinds of bytes: white space, letters, others
KIND = np.full(256, 2, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[97:123] = KIND[65:91] = KIND[128:] = 1
_rng = np.random.default_rng(29)
_BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_WEIGHTS = [(_rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)) * (KIND > 0) for _ in _BASES]


def sure(text: bytes) -> bool:
    return not (b"'" in text or b"<|" in text if text.isascii() else _UNSURE.search(text))


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists], np.int64)


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, one run after the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


class PieceTable:
    """Numbers of pieces by their 128-bit hashes, looked up for whole arrays (open addressing, at most half full)."""

    def __init__(self):
        self.keep(0)

    def keep(self, number: int | None = None) -> None:
        """Starts anew with the first pieces, None for all, and room for as many again."""
        keys = self.keys[:, :number] if number != 0 else np.zeros((2, 0), np.uint64)
        self.bits = max(12, (4 * keys.shape[1]).bit_length())
        self.mask = (1 << self.bits) - 1
        self.place = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys[:, :0]
        self.add(keys)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return (keys[0] >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 for unknown ones."""
        out = np.full(keys.shape[1], -1, np.int64)
        todo, at = np.arange(keys.shape[1]), self.home(keys)
        while len(todo):
            found = self.place[at]
            here = found >= 0
            todo, at, found = todo[here], at[here], found[here]
            same = (self.keys[0][found] == keys[0][todo]) & (self.keys[1][found] == keys[1][todo])
            out[todo[same]] = found[same]
            todo, at = todo[~same], (at[~same] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray) -> None:
        """Numbers new, distinct pieces from where the table ends."""
        if 2 * (self.keys.shape[1] + keys.shape[1]) > 1 << self.bits:
            self.keys = np.concatenate([self.keys, keys], axis=1)
            return self.keep()
        number = self.keys.shape[1] + np.arange(keys.shape[1], dtype=np.int32)
        self.keys = np.concatenate([self.keys, keys], axis=1)
        at = self.home(keys)
        while len(number):
            free = self.place[at] < 0
            self.place[at[free]] = number[free]
            won = self.place[at] == number
            number, at = number[~won], (at[~won] + 1) & self.mask


def load(path: str):
    """(tokenizer, the same model for lower-case ASCII words, whether an id ends a word where the vocabulary marks it).

    Normal form and splitter leave lower-case ASCII words as they are."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    plain = Tokenizer(library.model)
    plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    ends = np.zeros(library.get_vocab_size(), bool)
    ends[[i for t, i in library.get_vocab().items() if t.endswith("</w>")]] = True
    return library, plain, ends


class Encoder:
    """Token ids of texts through a bounded cache of pieces, which the tasks of a worker share (`encoder`)."""

    def __init__(self, path: str):
        self.library, self.plain, self.ends = worker_state(f"tokenizer {path}", lambda: load(path))
        self.powers = [Powers(base) for base in _BASES]
        self.table = PieceTable()
        self.ids = np.zeros(0, np.int32)
        self.start = self.size = np.zeros(0, np.int64)
        #: the pieces themselves, one after the other
        self.bytes = np.zeros(0, np.uint8)
        self.byte_start = self.byte_size = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Drops the pieces that came last; frequent ones mostly come early."""
        kept = min(len(self.size), CACHE) // 2
        if self.size[:kept].sum() > CACHE_IDS // 2:
            kept = 0
        self.table.keep(kept)
        self.start, self.size = self.start[:kept].copy(), self.size[:kept].copy()
        self.ids = self.ids[:int(self.size.sum())].copy()
        self.byte_start, self.byte_size = self.byte_start[:kept].copy(), self.byte_size[:kept].copy()
        self.bytes = self.bytes[:int(self.byte_size.sum())].copy()

    @staticmethod
    def coded(library, texts: list[str]) -> list[list[int]]:
        return [c.ids for c in library.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, library, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of words of letters alone, encoded as lines and cut where an id ends a word."""
        lines = [words[i:i + 500] for i in range(0, len(words), 500)]
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for line, coded in zip(lines, self.coded(library, [" ".join(x) for x in lines])):
            coded = np.array(coded, np.int32)
            size = np.diff(np.flatnonzero(self.ends[coded]), prepend=-1)
            if len(size) != len(line) or size.sum() != len(coded):
                coded, size = flat(self.coded(self.library, line))
            ids.append(coded)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def learn(self, pieces: list[bytes]) -> None:
        """Encodes new pieces.  ASCII marks after letters are a run of their own, unless an apostrophe is among them."""
        texts = b"\n".join(pieces).decode().split("\n")
        cut = [t.rstrip(MARKS) for t in texts]
        cut = [c if c.isalpha() and c[-1] != "\u0130" else t for c, t in zip(cut, texts)]
        marks: dict[str, int] = {"": 0}
        tail = np.array([marks.setdefault(t[len(c):], len(marks)) for c, t in zip(cut, texts)], np.int64)
        number: dict[str, int] = {}
        of = np.array([number.setdefault(c.lower() if c.isascii() and c.isalpha() else c, len(number)) for c in cut])
        group = np.array([0 if c.isascii() and c.isalpha() else 1 if c.isalpha() else 2 for c in number])
        stems = [[], [], []]
        for c, g in zip(number, group.tolist()):
            stems[g].append(c)
        order = np.argsort(group, kind="stable")
        parts = [self.words(self.plain, stems[0]), self.words(self.library, stems[1]),
                 flat(self.coded(self.library, stems[2])), flat(self.coded(self.library, list(marks)))]
        ids, size = (np.concatenate(x) for x in zip(*parts))
        start = np.cumsum(size) - size
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        # two runs for each piece: the stem, then the tail or nothing
        run = np.c_[place[of], tail + len(order)]
        run_size = size[run]
        fresh = ids[spans(start[run].ravel(), run_size.ravel())]
        size = run_size.sum(axis=1)
        self.start = np.r_[self.start, len(self.ids) + np.cumsum(size) - size]
        self.size = np.r_[self.size, size]
        self.ids = np.r_[self.ids, fresh]
        length = np.array([len(x) for x in pieces], np.int64)
        self.byte_start = np.r_[self.byte_start, len(self.bytes) + np.cumsum(length) - length]
        self.byte_size = np.r_[self.byte_size, length]
        self.bytes = np.r_[self.bytes, np.frombuffer(b"".join(pieces), np.uint8)]

    def whole(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """What a call gives, without the cache."""
        return flat([[*ids, end] for ids in self.coded(self.library, [t.decode() for t in texts])])

    def __call__(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each text's number of ids), `end` after each text.

        Pieces are runs of letters or of other characters where the library is
        sure to cut between those, else what stands between ASCII white space.
        """
        known = np.array([sure(t) for t in texts], bool)
        blob = b"\n".join([t.lower() if k else t for t, k in zip(texts, known)]) + b"\n"
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        data = np.frombuffer(blob, np.uint8)
        kind = KIND[data]
        if not known.all():
            kind[np.repeat(~known, np.diff(first)) & (kind == 2)] = 1
        change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        start = np.r_[0, change] if kind[0] else change
        start = start[kind[start] > 0]
        stop = change[kind[change - 1] > 0]
        count = np.diff(np.searchsorted(start, first))
        if not len(start):
            return np.full(len(texts), end, np.int32), np.ones(len(texts), np.int64)
        keys = np.array([np.add.reduceat(w[data] * p.reach(len(data))[0][:len(data)], start) * p.down[start]
                         for w, p in zip(_WEIGHTS, self.powers)])
        if len(self.size) > CACHE or len(self.ids) > CACHE_IDS:
            self.forget()
        slot = self.table.find(keys)
        # once, unless two new pieces share half of their hash
        while (slot < 0).any():
            new = np.flatnonzero(slot < 0)
            _, one = np.unique(keys[0][new], return_index=True)
            one = new[one]
            self.learn([blob[a:b] for a, b in zip(start[one].tolist(), stop[one].tolist())])
            self.table.add(keys[:, one])
            slot[new] = self.table.find(keys[:, new])
        length = stop - start
        same = np.array_equal(self.byte_size[slot], length) and np.array_equal(
            self.bytes[spans(self.byte_start[slot], length)], data[kind > 0])
        if not same:
            return self.whole(texts, end)
        size = self.size[slot]
        text_of = np.repeat(np.arange(len(texts)), count)
        total = np.bincount(text_of, size, minlength=len(texts)).astype(np.int64) + 1
        # ids of the pieces in order; each text's end id takes the place after its last piece
        source = spans(self.start[slot], size)
        out = np.full(total.sum(), end, np.int32)
        out[np.arange(len(source)) + np.repeat(text_of, size)] = self.ids[source]
        return out, total


def encoder(path: str) -> Encoder:
    """The worker's encoder: a task finds the pieces that earlier ones have encoded."""
    return worker_state(f"encoder {path}", lambda: Encoder(path))


def _encode(path: str, end: int, names: list[str]):
    def run(batches):
        encode, part, before = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            data = memoryview(data)
            for low, high in row_slices(offsets, 1 << 19, rows=4096):
                ids, size = encode([bytes(data[a:b]) for a, b in zip(offsets[low:high], offsets[low + 1:high + 1])], end)
                start = np.cumsum(size) - size
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(size)].astype(np.int32), ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(high - low, part, np.int32)), batch.column(0)[low:high],
                     pa.array(before + start), pa.array(size), lists], names=names)
                before += int(size.sum())
    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int = END, id_col: str = "doc_id",
              text_col: str = "text") -> None:
    """Encodes every whole text, appends `end` and writes the files in ascending id order.

    A null or empty text is `end` alone.  Rows with a null id come first, rows
    that share an id are ordered by a hash of their text (so they may lie in
    several files) and each keeps its own row.  Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    tie = F.xxhash64("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    names = ["part", "doc_id", "local_start", "n_tokens", "ids"]
    coded = rows.mapInArrow(_encode(tokenizer, end, names),
                            f"part int, doc_id {kind}, local_start long, n_tokens long, ids array<int>")
    coded.write.options(**ORC).orc(path)


def layout(spark: SparkSession, path: str) -> DataFrame:
    """(part, part_start, rows, tokens) of each file that has rows; one row per file."""
    sizes = spark.read.orc(path).groupBy("part").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"))
    sizes.createOrReplaceTempView(view := f"layout_{uuid.uuid4().hex}")
    return spark.sql(f"SELECT part, sum(tokens) OVER (ORDER BY part) - tokens AS part_start, rows, tokens FROM {view}")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all rows; start: ids of all rows before."""
    rows = spark.read.orc(path)
    # one row per file: no more than a listing of the folder holds
    return rows.join(F.broadcast(layout(spark, path)).select("part", "part_start"), "part").select(
        "doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def find_ids(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; the filter is pushed to the files' row indexes and Bloom filters."""
    return read_ids(spark, path).where(F.col("doc_id").isin(doc_ids))


def digest(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from rows with their ids."""
    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            values = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            ends = ids.offsets.to_numpy()
            crc = [zlib.crc32(values[4 * a:4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            size = pa.array(np.diff(ends).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size, pa.array(crc, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the files into the shared folder and returns the digest read back from them."""
    spark = docs.sparkSession
    path = f"{stage_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer or tokenizer_path())
    return digest(read_ids(spark, path))


def op10_tokenids(spark, sf_dir) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))


QUERIES = {"op10_tokenids": (op10_tokenids, None)}
