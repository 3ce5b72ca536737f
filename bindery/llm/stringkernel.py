"""Language identification by a string kernel.

Two texts are as alike as the share of byte n-grams (one to three bytes, blended)
that occur in both: a presence kernel, normalised to one for equal sets.  Texts
enter lower-cased in A-Z with every other ASCII byte as one separator symbol.
One-versus-rest kernel ridge regression is fitted in the span of a few landmark
texts of each language (Nyström), on a bounded sample of labelled rows.  Since the
kernel is linear in the presence vectors, landmarks and coefficients fold into
one matrix, and texts are scored by products of whole batches with it.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_view, id_crc, row_slices, table

#: labelled rows of each language that the model is fitted on, at most; landmarks of each
SAMPLE, LANDMARKS = 500, 64
RIDGE = 1e-3
#: what the share of known n-grams of a text may lie below that of labelled texts
SLACK = 0.15
#: steps of a share
SHARES = 10_000
#: values of `lang_pred` for texts that are null or hold no letter
UNDETERMINED = "und"

SYMBOL = np.zeros(256, np.int32)
SYMBOL[97:123] = SYMBOL[65:91] = np.arange(1, 27)
SYMBOL[128:] = np.arange(27, 155)
_N = int(SYMBOL.max()) + 1
CODES = _N + _N**2 + _N**3
#: cells of a presence matrix
CELLS = 1 << 22


def ngrams(data: np.ndarray, offsets: np.ndarray):
    """(row, code) of every n-gram of one to three bytes that lies in one text."""
    symbol = SYMBOL[data]
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    yield row, symbol
    two = symbol[:-1] * _N + symbol[1:]
    same = row[:-1] == row[1:]
    yield row[:-1][same], two[same] + _N
    three = two[:-1] * _N + symbol[2:]
    same = row[:-2] == row[2:]
    yield row[:-2][same], three[same] + (_N + _N**2)


def presence(data: np.ndarray, offsets: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """Rows by vocabulary: one where the n-gram occurs.  place: column of each code, `width` for none."""
    seen = np.zeros((len(offsets) - 1, width + 1), np.uint8)
    flat = seen.reshape(-1)
    for row, code in ngrams(data, offsets):
        flat[row * (width + 1) + place[code]] = 1
    return seen[:, :width].astype(np.float32)


def _code_sets(batches):
    for batch in batches:
        data, offsets = byte_view(batch.column(1))
        sets = []
        for low, high in zip(offsets[:-1], offsets[1:]):
            seen = np.zeros(CODES, bool)
            for _, code in ngrams(data[low:high], np.array([0, high - low])):
                seen[code] = True
            sets.append(np.flatnonzero(seen).astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["lang", "codes"])


def sample(docs: DataFrame, labelled: Column, id_col: str, text_col: str, lang_col: str, size: int) -> DataFrame:
    """The first `size` labelled rows of each language in the order of their ids' hashes.

    A count of each language says up to which hash rows are needed, so that only
    about twice the sample is ranked.
    """
    # the hash as a uniform number in 0..1
    order = (F.xxhash64(id_col) / F.lit(float(1 << 64)) + 0.5).alias("o")
    docs = docs.where(labelled & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    docs = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), order)
    # as many rows again as are wanted, lest chance leave too few
    last = docs.groupBy("lang").agg((2 * size / F.count("*")).alias("last"))
    near = docs.join(F.broadcast(last), "lang").where("o <= last")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("o", "text"))
    return near.withColumn("n", rank).where(f"n <= {size}").select("lang", "text")


class Model:
    """langs, vocabulary (n-gram codes) and weights (vocabulary by langs)."""

    def __init__(self, langs: list[str], codes: np.ndarray, weights: np.ndarray):
        self.langs, self.codes, self.weights = langs, codes, weights

    def place(self) -> np.ndarray:
        place = np.full(CODES, len(self.codes), np.int32)
        place[self.codes] = np.arange(len(self.codes), dtype=np.int32)
        return place


def fit(rows: list[tuple[str, bytes]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression from (lang, n-gram codes) rows; the first rows of each language are landmarks."""
    rows = sorted((lang, codes) for lang, codes in rows if len(codes))
    langs = sorted({lang for lang, _ in rows})
    if not rows:
        return Model([], np.zeros(0, np.int32), np.zeros((0, 0), np.float32))
    sets = [np.frombuffer(codes, "<i4") for _, codes in rows]
    vocabulary, uses = np.unique(np.concatenate(sets), return_counts=True)
    vocabulary = vocabulary[uses > 1] if (uses > 1).any() else vocabulary
    has = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, codes in enumerate(sets):
        has[i, np.searchsorted(vocabulary, np.intersect1d(codes, vocabulary))] = 1
    has /= np.sqrt(np.maximum(1, has.sum(axis=1, keepdims=True)))
    label = np.array([langs.index(lang) for lang, _ in rows])
    marks = np.concatenate([np.flatnonzero(label == k)[:landmarks] for k in range(len(langs))])
    basis = has[marks]
    cross, inner = (has @ basis.T).astype(float), (basis @ basis.T).astype(float)
    target = np.where(label[:, None] == np.arange(len(langs)), 1.0, -1.0)
    # one language's rows weigh as much as another's
    weight = (1 / np.bincount(label))[label][:, None] / len(langs)
    normal = cross.T @ (weight * cross) + ridge * inner + 1e-9 * np.eye(len(marks))
    solved = np.linalg.lstsq(normal, cross.T @ (weight * target), rcond=None)[0]
    return Model(langs, vocabulary, (basis.T @ solved).astype(np.float32))


def train(docs: DataFrame, labelled: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          size: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """Fits on at most `size` rows of each language among the `labelled` ones; only n-gram sets reach the driver."""
    rows = sample(docs, labelled, id_col, text_col, lang_col, size).mapInArrow(_code_sets, "lang string, codes binary")
    return fit([(r.lang, bytes(r.codes)) for r in rows.collect()], landmarks)


def has_letter(text: np.ndarray) -> bool:
    letter = SYMBOL[text]
    if ((letter > 0) & (letter < 27)).any():
        return True
    return bool(letter.any()) and any(c.isalpha() for c in text.tobytes().decode("utf-8", "replace"))


def language(model: Model, text_col: str = "text") -> Column:
    """struct(lang_pred, score) of a text; see `identify`."""
    def run(texts: pa.Array) -> pa.Array:
        place, width = model.place(), len(model.codes)
        data, offsets = byte_view(texts)
        pred, score = np.full(len(texts), -1), np.zeros(len(texts))
        for low, high in row_slices(offsets, rows=max(1, CELLS // (width + 1))) if width else ():
            part = data[offsets[low]:offsets[high]]
            seen = presence(part, offsets[low:high + 1] - offsets[low], place, width)
            value = seen @ model.weights / np.sqrt(np.maximum(1, seen.sum(axis=1, keepdims=True)))
            pred[low:high] = value.argmax(axis=1)
            score[low:high] = np.clip((value.max(axis=1) + 1) / 2, 0, 1)
        for i in range(len(texts)):
            if not has_letter(data[offsets[i]:offsets[i + 1]]):
                pred[i], score[i] = -1, 0
        names = [*model.langs, UNDETERMINED]
        return pa.StructArray.from_arrays([pa.array([names[p] for p in pred], pa.string()), pa.array(score)],
                                          names=["lang_pred", "score"])

    return F.arrow_udf(run, "struct<lang_pred: string, score: double>")(F.coalesce(F.col(text_col), F.lit("")))


def familiar(model: Model, text_col: str = "text") -> Column:
    """Share of a text's three-byte n-grams, each as often as it occurs, that the model's vocabulary holds.

    N-grams with more than one separator do not count; a text without any other has share one.
    """
    def run(texts: pa.Array) -> pa.Array:
        known = np.zeros(CODES, bool)
        known[model.codes] = True
        data, offsets = byte_view(texts)
        share = np.ones(len(texts))
        for low, high in row_slices(offsets):
            part = data[offsets[low]:offsets[high]]
            *_, (row, code) = ngrams(part, offsets[low:high + 1] - offsets[low])
            three = code - (_N + _N**2)
            letters = (three >= _N**2).astype(np.int8) + (three // _N % _N > 0) + (three % _N > 0)
            row, code = row[letters > 1], code[letters > 1]
            total = np.bincount(row, minlength=high - low)
            hits = np.bincount(row, weights=known[code], minlength=high - low)
            share[low:high] = np.where(total > 0, hits / np.maximum(1, total), 1.0)
        return pa.array(share)

    return F.arrow_udf(run, "double")(F.coalesce(F.col(text_col), F.lit("")))


def least_familiar(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> float:
    """The share (`familiar`) that 99 of 100 labelled texts of every language reach, less `SLACK`.

    Every labelled text counts; shares are told apart by `SHARES` steps, so that a language is no more rows than that.
    """
    docs = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    shares = docs.select(F.col(lang_col).alias("lang"), F.floor(familiar(model, text_col) * SHARES).alias("share"))
    steps = shares.groupBy("lang", "share").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("lang")
    below = steps.withColumns({"upto": F.sum("n").over(whole.orderBy("share")), "all": F.sum("n").over(whole)})
    last = below.where("upto * 100 > all").groupBy("lang").agg(F.min("share").alias("share"))
    found = last.agg(F.min("share")).first()[0]
    return 0.0 if found is None else found / SHARES - SLACK


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row, from the whole text alone.

    score is the best regression value, which aims at 1 for a language and -1
    for the rest, moved to 0..1; languages that tie go by name.  Texts that are
    null or hold no letter are `und` with score 0, and so is every text if
    nothing was learned.  Repeated rows are judged one by one; other columns
    are not read.
    """
    return docs.select(id_col, language(model, text_col).alias("l")).select(id_col, "l.lang_pred", "l.score")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(id_crc(id_col) % 4 == 2, F.lit(False))


def op4_stringkernel(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs, id_crc("doc_id") % 4 != 2))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_stringkernel": (op4_stringkernel, None)}
