"""The corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; every one but the last returns the columns of `documents`.
"""
from __future__ import annotations

import os
import sys
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bindery.llm import mixing, shingles, simhash, stringkernel, tokenids, wumanber  # noqa: E402
from bindery.llm.common import components, table  # noqa: E402
from bindery.staging import stage  # noqa: E402

#: rows of an Arrow batch
BATCH = 2000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; texts without a letter and those like no learned language go.

    A text is like a learned language if the model knows about as large a share of its
    n-grams as of the labelled texts' own; the score says only which language is nearest.
    That one becomes the `lang` of a document without a label.  Every labelled row may be learned from,
    as nothing is held out here, and every labelled text counts for what is familiar.
    Without any labelled row there is nothing to reject by, and only texts without a letter go.
    """
    model = stringkernel.train(docs, F.lit(True))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    least = stringkernel.least_familiar(docs, model)
    # inside a generator the texts are judged once, though the verdict is asked for twice
    found = F.struct(stringkernel.language(model)["lang_pred"].alias("_pred"), stringkernel.familiar(model).alias("_share"))
    kept = docs.select("*", F.inline(F.array(found))).where((F.col("_pred") != stringkernel.UNDETERMINED) & (F.col("_share") >= least))
    return kept.select(*[F.coalesce("lang", "_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: texts whose fingerprints differ in three bits
    or fewer (`simhash`), or whose five-word shingles are alike by 0.8 or more (`shingles`).

    It is the one whose id is the smallest of the group, the first by text and source if several
    rows of the group have that id.  Documents without an id cannot name a group and stay.
    Groups are found among row numbers, so the texts are not shuffled.
    """
    rows, _, linked = shingles.linked_sets(docs)
    prints = simhash.near_duplicates(rows.select("nth", "row.text"), id_col="nth").select("nth", F.col("component_id").alias("b"))
    sets = rows.select("nth", F.col("row.doc_id").alias("doc_id"), F.col("s.bits").alias("bits")).join(linked, "bits", "left")
    sets = stage(sets.select("nth", "doc_id", F.coalesce("root", "bits").alias("root")), "dedup-sets")
    firsts = stage(sets.groupBy("root").agg(F.min("nth").alias("a")), "dedup-firsts")
    # a group of either kind goes by its first row, so the groups that a row is in are linked by two row numbers
    both = stage(sets.join(firsts, "root").join(prints, "nth").select("nth", "doc_id", "a", "b"), "dedup-both")
    joined = components(both.select("a", "b"), "dedup-joined")
    named = both.join(joined, F.col("a") == F.col("node"), "left").select("nth", "doc_id", F.coalesce("root", "a").alias("group"))
    named = stage(named.where("doc_id is not null"), "dedup-named")
    least = stage(named.groupBy("group").agg(F.min("doc_id").alias("doc_id")), "dedup-least")
    bearing = stage(named.join(least, ["group", "doc_id"]).select("nth", "group"), "dedup-bearing")
    tied = bearing.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    tied = stage(bearing.join(tied, "group"), "dedup-tied")
    texts = rows.select("nth", "row.text", "row.source").join(shingles.short(tied), "nth")
    first = texts.groupBy("group").agg(F.min(F.struct("text", "source", "nth")).alias("first")).select(F.col("first.nth").alias("nth"))
    kept = bearing.join(tied.select("nth"), "nth", "left_anti").select("nth").union(first)
    dropped = stage(named.select("nth").join(kept, "nth", "left_anti"), "dedup-dropped")
    return rows.join(shingles.short(dropped), "nth", "left_anti").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")
    judged = wumanber.contamination(rows, table(spark, sf_dir, "benchmark"), id_col="row", keep_text=True)
    return judged.where("not contaminated").select(
        *[F.col("text") if c == "text" else F.col(f"row.{c}") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that domains come to their target shares; a rate is at most 1, so nothing is repeated."""
    rate, _ = mixing.mixing(docs, table(spark, sf_dir, "labels"), cap=1.0)
    return docs.where(mixing.drawn(rate, "doc_id", "text") > 0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files; the digest of each document as read back from them."""
    return tokenids.token_files(docs)


def in_small_batches(step):
    """The stage with Arrow batches of BATCH rows, as five stages share the executors' memory; results do not depend on it."""
    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
        return step(spark, docs, sf_dir)
    return run_step


STAGES = [(name, in_small_batches(step)) for name, step in (
    ("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens))]

#: learned models, fingerprint components and a tokenizer have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
