"""Mixing a corpus to target weights with soft domain membership.

A softmax classifier over word presence, fitted on the labelled table, gives each
document a posterior over domains.  A document's rate says how often it is drawn,
so the expected tokens of a domain are the sum of rate * tokens * posterior.  The
rates solve a nonnegative least-squares problem by projected gradient steps: each
step is one aggregation of a narrow table to as many sums as there are domains.
A rate depends on its document's posterior and on the steps so far, so it is a
column expression and no per-document state is kept between steps.
"""
from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .common import byte_view, row_slices, table
from .wordscan import Powers, Words

#: labelled rows that the classifier is fitted on, at most
SAMPLE = 4_000
BUCKET_BITS = 12
ROUNDS, TOLERANCE, PULL = 30, 1e-3, 1e-3
#: the gradient's Lipschitz constant is 1 + PULL in the metric of fit_rates
STEP = 1 / (1 + PULL)
#: domains of the labelled table and the token shares that the query asks for
WEIGHTS = {"good": 0.90, "low": 0.08, "toxic": 0.02}


def label_domain() -> Column:
    """The domain of a labelled row, null without labels."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "low")


def presence(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(words per row, rows by buckets: whether a word of the bucket occurs)."""
    words = Words(data, offsets, powers)
    number = np.diff(words.first)
    has = np.zeros((len(number), 1 << BUCKET_BITS), bool)
    has[np.repeat(np.arange(len(number)), number), words.hash >> np.uint64(64 - BUCKET_BITS)] = True
    return number, has


@dataclass
class Classifier:
    """Softmax weights over word buckets; without domains every posterior is empty."""
    domains: list[str] = field(default_factory=list)
    #: weight of each bucket in a text, larger for rare ones
    rarity: np.ndarray = field(default_factory=lambda: np.ones(1 << BUCKET_BITS, np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(((1 << BUCKET_BITS) + 1, 0), np.float32))

    def inputs(self, has: np.ndarray) -> np.ndarray:
        x = has * self.rarity
        x /= np.sqrt(np.maximum(1e-9, (x * x).sum(axis=1, keepdims=True)))
        return np.c_[x, np.ones(len(x), np.float32)]

    def posterior(self, has: np.ndarray) -> np.ndarray:
        return softmax(self.inputs(has) @ self.weights)


def softmax(value: np.ndarray) -> np.ndarray:
    value = np.exp((value - value.max(axis=1, keepdims=True, initial=-np.inf)).astype(float))
    return value / value.sum(axis=1, keepdims=True)


def fit_classifier(has: np.ndarray, domain: list[str], rounds: int = 300, ridge: float = 1e-5) -> Classifier:
    model = Classifier(sorted(set(domain)))
    if not model.domains:
        return model
    model.rarity = (1 / np.sqrt(has.mean(axis=0) + 0.002)).astype(np.float32)
    x = model.inputs(has)
    y = np.array(domain)[:, None] == np.array(model.domains)
    top = np.ones((x.shape[1], 1), np.float32)
    for _ in range(10):
        top = x.T @ (x @ top)
        top /= np.linalg.norm(top)
    rate = 2 * len(x) / float(np.square(x @ top).sum())
    w = z = np.zeros((x.shape[1], len(model.domains)), np.float32)
    for k in range(rounds):
        slope = x.T @ (softmax(x @ z) - y).astype(np.float32) / len(x)
        new = z - np.float32(rate) * (slope + np.float32(ridge) * z)
        z = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    model.weights = w
    return model


def train(docs: DataFrame, labels: DataFrame, domain: Column | None = None, id_col: str = "doc_id",
          text_col: str = "text", size: int = SAMPLE) -> Classifier:
    """Fits on the first `size` labelled ids in the order of their hashes; bucket sets of fixed size reach the driver.

    Of several labels of an id the first domain by name counts, of several texts the smallest bucket set.
    """
    domain = label_domain() if domain is None else domain
    chosen = (labels.select(F.col(id_col).alias("id"), domain.alias("domain")).dropna()
              .groupBy("id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("id"), "id").limit(size))

    def run(batches):
        powers = Powers()
        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            for low, high in row_slices(offsets, rows=256):
                _, has = presence(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], powers)
                bits = [row.tobytes() for row in np.packbits(has, axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array(bits, pa.binary())],
                                                 names=["id", "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = texts.join(F.broadcast(chosen.select("id")), "id", "left_semi").mapInArrow(run, f"id {kind}, bits binary")
    rows = sets.groupBy("id").agg(F.min("bits").alias("bits")).join(F.broadcast(chosen), "id").collect()
    rows = sorted((r.id, bytes(r.bits), r.domain) for r in rows)
    has = np.unpackbits(np.frombuffer(b"".join(b for _, b, _ in rows), np.uint8).reshape(-1, 1 << BUCKET_BITS - 3), axis=1)
    return fit_classifier(has, [d for _, _, d in rows])


def membership(model: Classifier, text_col: str = "text") -> Column:
    """struct(n_tokens, p): the words of a text and its posterior over the model's domains."""
    kind = pa.struct([("n_tokens", pa.int64()), ("p", pa.list_(pa.float64()))])

    def run(texts: pa.Array) -> pa.Array:
        data, offsets = byte_view(texts)
        powers, numbers, chances = Powers(), [np.zeros(0, np.int64)], [np.zeros((0, len(model.domains)))]
        for low, high in row_slices(offsets, rows=256):
            number, has = presence(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], powers)
            numbers.append(number)
            chances.append(model.posterior(has))
        p = np.concatenate(chances)
        lists = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1], p.ravel())
        return pa.StructArray.from_arrays([pa.array(np.concatenate(numbers)), lists], fields=list(kind))

    # the text is made non-null so that rows with and without text take the same path
    return F.arrow_udf(run, "struct<n_tokens: bigint, p: array<double>>")(F.coalesce(F.col(text_col), F.lit("")))


@dataclass
class Rates:
    """The fitted rates: every step is one slope per domain; have, target, fitted: expected tokens by domain."""
    domains: list[str]
    steps: list[list[float]]
    cap: float | None
    have: list[float]
    target: list[float]
    fitted: list[float]

    def column(self, p: Column) -> Column:
        """Rate of a document with posterior `p`."""
        rate = F.lit(1.0)
        for step in self.steps:
            slope = sum((p[i] * s for i, s in enumerate(step)), F.lit(0.0))
            rate = F.greatest(F.lit(0.0), rate * (1 - STEP * PULL) + STEP * PULL - slope)
            if self.cap is not None:
                rate = F.least(F.lit(float(self.cap)), rate)
        return rate


def fit_rates(members: DataFrame, domains: list[str], weights: Mapping[str, float], total: float | None = None,
              cap: float | None = None) -> Rates:
    """Rates for a table (n_tokens, p) so that expected domain tokens come to `weights` of `total`.

    Minimises  miss' M miss / 2  +  PULL/2 * sum of n_tokens * (rate - 1)^2  over 0 <= rate (<= cap), where miss holds
    the domains' tokens less their targets and M inverts the tokens that domains share: domains that many documents
    belong to at once are told apart as fast as others.  The pull to 1 picks one of the many solutions.  Gradients
    are taken per token, which makes the steps independent of document lengths.  `total` None: the tokens there are; with a `cap` the most tokens that
    keep every domain's target within cap times what it has.  Domains without a weight have the target 0, weights of
    domains that no document belongs to are unreachable and change nothing.
    """
    n = len(domains)
    n_tokens, p = F.col("n_tokens"), F.col("p")
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    first = members.agg(F.sum(n_tokens).cast("double"), *[F.sum(n_tokens * p[i]) for i in range(n)],
                        *[F.sum(n_tokens * p[i] * p[j]) for i, j in pairs]).first()
    tokens, have = first[0] or 0.0, np.array([x or 0.0 for x in first[1:n + 1]])
    share = np.array([max(0.0, weights.get(d, 0.0)) for d in domains], float)
    if not tokens or not share.sum():
        return Rates(domains, [], cap, have.tolist(), have.tolist(), have.tolist())
    share /= share.sum()
    if total is None:
        total = tokens if cap is None else min(tokens, cap * min(h / s for h, s in zip(have, share) if s and h))
    target = share * total
    gram = np.zeros((n, n))
    for (i, j), x in zip(pairs, first[n + 1:]):
        gram[i, j] = gram[j, i] = x or 0.0
    metric = np.linalg.pinv(gram, rcond=1e-6)
    rates = Rates(domains, [], cap, have.tolist(), target.tolist(), [])
    now = have
    for _ in range(ROUNDS):
        if np.abs(now - target).max() <= TOLERANCE * total:
            break
        rates.steps.append([float(f"{x:.12g}") for x in STEP * metric @ (now - target)])
        rate = rates.column(p)
        now = np.array(members.select(n_tokens, p, rate.alias("rate"))
                       .agg(*[F.sum(F.col("rate") * n_tokens * p[i]) for i in range(n)]).first(), float)
    rates.fitted = now.tolist()
    return rates


def mixing(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float] = WEIGHTS, cap: float | None = None,
           id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Rates]:
    """(rate column for the rows of `docs`, the fit).

    The column is computed from the text alone, so it holds for every row: null
    and empty texts have no tokens and the classifier's prior posterior, repeated
    rows have equal rates.  Without labelled rows there is no domain and every rate is 1.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    if not model.domains:
        return F.lit(1.0), Rates([], [], cap, [], [], [])
    one = membership(model, text_col)
    members = stage(docs.select(one.alias("m")).select("m.n_tokens", "m.p"), "mixing")
    rates = fit_rates(members, model.domains, weights, cap=cap)
    return rates.column(one["p"]), rates


def drawn(rate: Column, *keys: str) -> Column:
    """Copies of a row that a rate stands for: its whole part, and one more where a uniform hash of the keys is less
    than the rest."""
    uniform = F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))
    return F.ceil(rate - uniform)


def op8_mixing(spark, sf_dir) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels)
    members = stage(docs.select("doc_id", membership(model).alias("m")).select("doc_id", "m.*"), "mixing")
    rate = fit_rates(members, model.domains, WEIGHTS).column(F.col("p")) if model.domains else F.lit(1.0)
    return members.select("doc_id", "n_tokens", F.col("p").alias("posterior"), rate.alias("rate"),
                          drawn(rate, "doc_id").alias("copies"))


QUERIES = {"op8_mixing": (op8_mixing, None)}
