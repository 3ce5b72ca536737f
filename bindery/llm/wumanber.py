"""Benchmark decontamination: Wu-Manber search for the windows of test items.

The alphabet is the word.  Patterns of one length share the tables of Wu and
Manber: the shift table says how far the search may move on after seeing a block
of words, the suffix buckets name the patterns that end with a block, and a
direct comparison of the words' bytes confirms an occurrence.  Documents are cut
into lanes that advance together, so the search runs in arrays.

Test items are compiled in slices of bounded size.  Each slice is one pass over
the documents, chained without a shuffle; one slice is enough for 500,000 words.
"""
from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_view, row_slices, table
from .wordscan import LOWER, Powers, Words

WINDOW = 13
BLOCK = 3
SLICE_WORDS = 500_000
#: words of a lane: documents are searched in pieces of this many window ends
LANE = 256
_MIX = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Tables:
    """Shift table and suffix buckets of patterns that all have `length` words."""

    def __init__(self, patterns: dict[bytes, set[str]], length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.texts = sorted(patterns)
        self.items = [sorted(patterns[t]) for t in self.texts]
        joined = np.frombuffer(b"\n".join(self.texts), np.uint8)
        hashes = Words(joined, np.array([0, len(joined)]), Powers()).hash.reshape(-1, length)
        self.bits = max(12, int(np.ceil(np.log2(max(1, hashes.size) * 8))))
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.int64)
        for end in range(self.block - 1, length):
            np.minimum.at(self.shift, self.slot(hashes, end), length - 1 - end)
        last = self.slot(hashes, length - 1)
        order = np.argsort(last, kind="stable")
        self.bucket = order
        self.bounds = np.searchsorted(last[order], np.arange((1 << self.bits) + 1))
        self.hashes = hashes

    def slot(self, hashes: np.ndarray, end) -> np.ndarray:
        """Table slot of the block of words that ends at `end` (last axis)."""
        mixed = np.uint64(0)
        for i in range(self.block):
            mixed = mixed + hashes[..., end - i] * _MIX[i]
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, words: Words, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(index of the last word, pattern) of all occurrences that lie in one text each."""
        counts = np.diff(words.first)
        pieces = np.maximum(0, -(-(counts - self.length + 1) // LANE))
        doc = np.repeat(np.arange(len(counts)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = words.first[doc] + self.length - 1 + nth * LANE
        stop = np.minimum(at + LANE, words.first[doc + 1])
        found_at, found = [], []
        while len(at):
            slot = self.slot(words.hash, at)
            step = self.shift[slot]
            here = step == 0
            if here.any():
                low, high = self.bounds[slot[here]], self.bounds[slot[here] + 1]
                size = high - low
                place = np.repeat(at[here], size)
                which = self.bucket[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())]
                same = np.ones(len(place), bool)
                for i in range(self.length):
                    same &= words.hash[place - i] == self.hashes[which, self.length - 1 - i]
                found_at.append(place[same])
                found.append(which[same])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, which = np.concatenate(found_at), np.concatenate(found)
        sure = np.array([self.compare(words, text, p, w) for p, w in zip(place.tolist(), which.tolist())], bool)
        return place[sure], which[sure]

    def compare(self, words: Words, text: bytes, place: int, which: int) -> bool:
        spans = zip(words.start[place - self.length + 1:place + 1], words.end[place - self.length + 1:place + 1])
        return b" ".join(text[a:b] for a, b in spans) == self.texts[which]


def compiled(items, window: int = WINDOW) -> list[Tables]:
    """Tables for (item id, text) pairs: one for each pattern length."""
    by_length: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = item_words(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            by_length[size][b" ".join(words[i:i + size])].add(item)
    return [Tables(patterns, size) for size, patterns in sorted(by_length.items())]


def item_words(text: str) -> list[bytes]:
    return re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())


def item_slices(benchmark: DataFrame, id_col: str, text_col: str, limit: int):
    """Lists of (item id, text) with about `limit` words each; rows without id or text are no items."""
    rows = benchmark.select(F.col(id_col).cast("string"), text_col).dropna()
    part, size = [], 0
    for item, text in rows.toLocalIterator():
        part.append((item, text))
        size += len(item_words(text))
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans, ascending; spans that touch become one."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > reach[:-1]] if len(start) else np.zeros(0, bool)
    return start[new], reach[np.r_[new[1:], True]] if len(start) else reach


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scan(tables, key: str, last: bool, keep_text: bool):
    """One pass: adds the occurrences of a slice of items to `spans` and `items`."""
    def run(batches):
        compiled_tables, powers = tables.value, Powers()
        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            counts, spans, items = [], batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for low, high in row_slices(offsets):
                part = LOWER[data[offsets[low]:offsets[high]]]
                words = Words(part, offsets[low:high + 1] - offsets[low], powers)
                counts.append(np.diff(words.first))
                text = part.tobytes()
                hits = defaultdict(list)
                for t in compiled_tables:
                    place, which = t.search(words, text)
                    doc = np.searchsorted(words.first, place, "right") - 1
                    for d, p, w in zip(doc.tolist(), (place - words.first[doc]).tolist(), which.tolist()):
                        hits[d].append((p + 1 - t.length, p + 1, t.items[w]))
                for d, own in hits.items():
                    old = [(s["start"], s["end"]) for s in spans[low + d]]
                    every = np.array(old + [h[:2] for h in own])
                    spans[low + d] = [{"start": a, "end": b}
                                      for a, b in zip(*(x.tolist() for x in merged(every[:, 0], every[:, 1])))]
                    items[low + d] = sorted({*items[low + d], *(i for h in own for i in h[2])})
            columns = {key: batch.column(0), "text": batch.column(1), "spans": pa.array(spans, _ARROW_SPANS),
                       "items": pa.array(items, pa.list_(pa.string())),
                       "n_words": pa.array(np.concatenate(counts) if counts else [], pa.int64())}
            if last and not keep_text:
                del columns["text"]
            if not last:
                del columns["n_words"]
            yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])
    return run


def occurrences(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                item_col: str = "item_id", item_text: str = "text", slice_words: int = SLICE_WORDS, keep_text: bool = False) -> DataFrame:
    """(id, n_words, spans, items) for every document, with keep_text also its text as `text`.

    spans: the word ranges (from 0, end excluded) that lie in an occurrence of
    a window of any item, united; items: sorted ids of the items with occurring
    windows.  A null text has no words.  Items with a null id or text, or
    without words, are not searched; items that share an id count as one.
    Repeated documents are judged one by one; other columns are not read.
    """
    spark, key = docs.sparkSession, docs.schema[id_col]
    kind = T.StructType([key, T.StructField("text", T.StringType()), T.StructField("spans", SPANS),
                         T.StructField("items", T.ArrayType(T.StringType()))])
    done = T.StructType([key, *kind.fields[1 if keep_text else 2:], T.StructField("n_words", T.LongType())])
    out = docs.select(id_col, F.col(text_col).alias("text"), F.array().cast(SPANS).alias("spans"),
                      F.array().cast("array<string>").alias("items"))
    slices = item_slices(benchmark, item_col, item_text, slice_words)
    part = next(slices, [])
    while True:
        after = next(slices, None)
        out = out.mapInArrow(_scan(spark.sparkContext.broadcast(compiled(part)), id_col, after is None, keep_text),
                             done if after is None else kind)
        if after is None:
            return out.select(id_col, *["text"] * keep_text, "n_words", "spans", "items")
        part = after


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """`occurrences` with n_hit (words inside any span), n_items and contaminated: at least one word in 20 is hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return occurrences(docs, benchmark, id_col, **columns).withColumns(
        {"n_hit": n_hit, "n_items": F.size("items").cast("long")}
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op3_wumanber(spark, sf_dir) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
          r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS t
      FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
            FROM b WHERE len(w) > 0)),
o AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS t
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
            FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)),
h AS (SELECT DISTINCT doc_id, k, i, item_id FROM o JOIN p USING (k, t)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                 string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES = {"op3_wumanber": (op3_wumanber, SQL)}
