"""Quality scores by a sparse rule ensemble.

Shallow trees are boosted on statistics of labelled texts; every path from a root
to a node is a rule, a conjunction of thresholds.  A logistic model with a lasso
penalty gives most rules the weight zero.  The rest compile into one Spark column
expression over the statistics, so scoring is a projection that the JVM compiles.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_view, id_crc, row_slices, table
from .wordscan import Powers, Words

#: labelled rows that the ensemble is fitted on, at most
SAMPLE = 20_000
TREES, DEPTH, LEAST, CUTS = 40, 3, 20, 24
SHRINK, PENALTY = 0.3, 1e-3
STATS = ["bytes", "words", "word_bytes", "upper", "digit", "space", "newline", "stop", "comma", "other_mark", "symbol",
         "pipe", "high", "distinct_words", "top_word", "longest_word"]
#: byte classes: position in STATS from `upper` on; lower-case letters have none
_NONE = 10
CLASS = np.full(256, 7, np.int64)
CLASS[97:123] = _NONE
CLASS[65:91] = 0
CLASS[48:58] = 1
CLASS[[9, 11, 12, 13, 32]] = 2
CLASS[10] = 3
CLASS[[ord(c) for c in ".?"]] = 4
CLASS[ord(",")] = 5
CLASS[[ord(c) for c in "!:;'\"()-"]] = 6
CLASS[ord("|")] = 8
CLASS[128:] = 9


def statistics(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> np.ndarray:
    """Rows by STATS; shares are of bytes, those of words of words, zero for texts without."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((rows, len(STATS)))
    row = np.repeat(np.arange(rows), size)
    counts = np.bincount(row * (_NONE + 1) + CLASS[data], minlength=rows * (_NONE + 1)).reshape(rows, -1)
    out[:, 0] = size
    out[:, 3:13] = counts[:, :_NONE] / np.maximum(1, size)[:, None]
    words = Words(data, offsets, powers)
    number = np.diff(words.first)
    out[:, 1] = number
    if len(words.hash):
        length = words.end - words.start
        own = np.repeat(np.arange(rows), number)
        has = np.flatnonzero(number)
        out[has, 2] = np.add.reduceat(length, words.first[has]) / number[has]
        out[has, 15] = np.maximum.reduceat(length, words.first[has])
        # a row's number above 48 bits of the word's hash
        key = np.sort((own.astype(np.uint64) << np.uint64(48)) | (words.hash >> np.uint64(16)))
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        run = np.diff(np.r_[new, len(key)])
        of = (key[new] >> np.uint64(48)).astype(np.int64)
        first = np.searchsorted(of, has)
        out[has, 13] = np.bincount(of, minlength=rows)[has] / number[has]
        out[has, 14] = np.maximum.reduceat(run, first) / number[has]
    return out


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one double per entry of STATS) for every row; a null text counts as empty."""
    def run(batches):
        powers = Powers()
        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            parts = [np.zeros((0, len(STATS)))]
            for low, high in row_slices(offsets):
                parts.append(statistics(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], powers))
            table_of = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in table_of.T)], names=[id_col, *STATS])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{s} double" for s in STATS))


@dataclass(frozen=True)
class Rule:
    """All of (statistic, threshold, above) hold."""
    parts: tuple[tuple[int, float, bool], ...]

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(x[:, s] > cut) == above for s, cut, above in self.parts])

    def column(self) -> Column:
        return reduce(and_, ((F.col(STATS[s]) > cut) if above else (F.col(STATS[s]) <= cut)
                             for s, cut, above in self.parts))


@dataclass
class Ensemble:
    intercept: float = 0.0
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self) -> Column:
        """Probability of label 1 as a column over STATS."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(rule.column(), float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _split(x, cuts, residual, rows):
    """(gain, statistic, threshold) that best parts the residuals of some rows."""
    best = (1e-9, None, None)
    r, total = residual[rows], residual[rows].sum()
    for s, own in enumerate(cuts):
        if not len(own):
            continue
        bin_of = np.searchsorted(own, x[rows, s], "left")
        n = np.cumsum(np.bincount(bin_of, minlength=len(own) + 1))[:-1]
        left = np.cumsum(np.bincount(bin_of, r, minlength=len(own) + 1))[:-1]
        m = len(rows) - n
        fits = (n >= LEAST) & (m >= LEAST)
        gain = np.where(fits, left**2 / np.maximum(1, n) + (total - left)**2 / np.maximum(1, m) - total**2 / len(rows), 0)
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (gain[i], s, float(own[i]))
    return best


def grow_rules(x: np.ndarray, y: np.ndarray, seed: int = 5) -> list[Rule]:
    """The paths of boosted trees, each grown on half of the rows."""
    cuts = [np.unique(np.quantile(x[:, s], np.linspace(0, 1, CUTS + 2)[1:-1])) for s in range(x.shape[1])]
    rng, rules = np.random.default_rng(seed), {}
    value = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-value))
        residual, spread = y - chance, chance * (1 - chance)
        nodes = [((), np.sort(rng.permutation(len(y))[:max(1, len(y) // 2)]), np.arange(len(y)))]
        for depth in range(DEPTH + 1):
            below = []
            for parts, rows, every in nodes:
                gain, s, cut = _split(x, cuts, residual, rows) if depth < DEPTH and len(rows) else (0, None, None)
                if s is None:
                    value[every] += SHRINK * residual[rows].sum() / (spread[rows].sum() + 1.0)
                    continue
                for above in (False, True):
                    path = (*parts, (s, cut, above))
                    rules[Rule(tuple(sorted(path)))] = None
                    below.append((path, rows[(x[rows, s] > cut) == above], every[(x[every, s] > cut) == above]))
            nodes = below
    return list(rules)


def lasso(on: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 400) -> tuple[float, np.ndarray]:
    """(intercept, weights) of a logistic model with an absolute penalty, by accelerated proximal gradient."""
    n = len(y)
    a = np.c_[np.ones(n, np.float32), on.astype(np.float32)]
    top = np.ones(a.shape[1])
    for _ in range(20):
        top = a.T @ (a @ top)
        top /= np.linalg.norm(top)
    rate = 4 * n / max(1e-9, float(top @ (a.T @ (a @ top))))
    w = z = np.zeros(a.shape[1])
    w[0] = z[0] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    for k in range(rounds):
        slope = a.T @ (1 / (1 + np.exp(-(a @ z))) - y) / n
        new = z - rate * slope
        new[1:] = np.sign(new[1:]) * np.maximum(0, np.abs(new[1:]) - rate * penalty)
        z = new + k / (k + 3) * (new - w)
        w = new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    if not len(y):
        return Ensemble()
    rules = grow_rules(x, y)
    on = np.array([r.of(x) for r in rules]).T.reshape(len(y), -1)
    intercept, weights = lasso(on, y)
    kept = np.flatnonzero(np.abs(weights) > 1e-6)
    return Ensemble(intercept, [rules[i] for i in kept], weights[kept].tolist())


def train(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", size: int = SAMPLE) -> Ensemble:
    """Fits on the first `size` labelled ids in the order of their hashes; only their statistics reach the driver.

    Of several labels of an id the smallest counts, of several texts the one with the smallest statistics.
    """
    chosen = (labels.where(learnable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .groupBy(id_col).agg(F.min(label_col).alias("y")).orderBy(F.xxhash64(id_col), id_col).limit(size))
    rows = (measured(docs.join(F.broadcast(chosen.select(id_col)), id_col, "left_semi"), id_col, text_col)
            .groupBy(id_col).agg(F.min(F.struct(*STATS)).alias("s")).join(F.broadcast(chosen), id_col)
            .select(id_col, "s.*", "y").toPandas().sort_values(id_col))
    return fit(rows[STATS].to_numpy(float), (rows["y"].to_numpy(float) > 0).astype(float))


def quality(docs: DataFrame, model: Ensemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row from its whole text; without labels to learn from every score is a half.

    Null and empty texts are scored by their statistics, which are all zero.
    Repeated rows are scored one by one; other columns are not read.
    """
    return measured(docs, id_col, text_col).select(id_col, model.score().alias("score"))


def op9_rulefit(spark, sf_dir) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, id_crc("doc_id") % 5 != 0)
    return quality(docs, model).select(
        "doc_id", F.coalesce(id_crc("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op9_rulefit": (op9_rulefit, None)}
