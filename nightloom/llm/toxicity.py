"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents labelled toxic, unlabelled ones any documents; both come only from rows of
which ``crc32(doc_id as text) mod 3`` is not 1, up to MAX_POSITIVE and MAX_UNLABELLED of them (the
bound on the sample that the model is fitted on). Features are hashed words and hashed word
beginnings (PREFIXES bytes), present or not. Those that tell the two samples apart best (FEATURES of
them, by the score of their difference, if at least PURITY of the texts they mark must be positive) enter a linear model trained in numpy with the non-negative risk

    prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)),

R+ and R- being mean logistic losses. The class prior is the share of toxic among the labelled rows
that may be learned from. Scoring is one pass over whole texts with a weight table of fixed size.

Defined results: null and empty texts get the model's constant. Labels of null doc_ids are left out,
conflicting labels of one doc_id count as toxic. A label without a document teaches nothing; without a
positive document every score is 0. The prior is kept between 1 / (n + 2) and (n + 1) / (n + 2) of n labels,
so that a table of toxic labels only is learned from too. Very long texts count whole; rows that repeat
are scored alike; an empty table gives an empty result. Of features with equal scores the lower number goes first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bounded_sample, crc_mod, documents, table, tokens

MAX_POSITIVE, MAX_UNLABELLED, FEATURES = 4000, 12000, 4096
BITS, PREFIXES = 20, (4, 5, 6)
THRESHOLD, EPOCHS, PENALTY, PURITY = 0.7, 300, 1e-4, 0.6


def piece_features(h: np.ndarray, start: np.ndarray, end: np.ndarray, hash_of) -> np.ndarray:
    """Feature numbers, one row per kind of feature and one column per word."""
    rows = [h]
    for n in PREFIXES:
        rows.append(hash_of(start, np.minimum(end, start + n)) * np.uint64(2 * n + 1))
    return (np.stack(rows) >> np.uint64(64 - BITS)).astype(np.int64)


def feature_rows(docs: DataFrame, chosen=None) -> DataFrame:
    """is_p, features (distinct; of the chosen ones only, if given)."""

    def run(batches):
        keep = None
        if chosen is not None:
            keep = np.full(1 << BITS, -1, np.int64)
            keep[chosen.value] = np.arange(len(chosen.value))
        for batch in batches:
            out = []
            for _, bounds, h, start, end, hash_of in tokens(batch.column(1), "alnum"):
                f = piece_features(h, start, end, hash_of)
                for a, b in zip(bounds[:-1], bounds[1:]):
                    own = np.unique(f[:, a:b])
                    if keep is not None:
                        own = keep[own]
                        own = own[own >= 0]
                    out.append(own.astype(np.int32))
            offs = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            flat = np.concatenate(out) if out else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], ["is_p", "features"])

    return docs.select(F.col("is_p").cast("int").alias("is_p"), F.col("text").cast("string").alias("text")).mapInArrow(run, "is_p int, features array<int>")


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list[np.ndarray], positive: np.ndarray, prior: float, n: int) -> tuple[np.ndarray, float]:
    """Weights and constant that minimise the non-negative risk, by Adam on the whole sample."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    w, b = np.zeros(n), np.log(prior / (1 - prior))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, EPOCHS + 1):
        z = b + np.bincount(of, w[flat], minlength=len(rows))
        p = sigmoid(z)
        loss_neg = np.logaddexp(0, z)
        rest = loss_neg[~positive].sum() / n_u - prior * loss_neg[positive].sum() / n_p
        up, down_u, down_p = np.where(positive, prior * (p - 1) / n_p, 0), np.where(positive, 0, p / n_u), np.where(positive, -prior * p / n_p, 0)
        # below zero, the unlabelled part is pushed up instead of down
        g = up + down_u + down_p if rest >= 0 else -(down_u + down_p)
        grad = np.append(np.bincount(flat, g[of], minlength=n) + PENALTY * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def constant(value: float) -> tuple[np.ndarray, float]:
    return np.zeros(1 << BITS, np.float32), value


def train(docs: DataFrame, labels: DataFrame, trainable) -> tuple[np.ndarray, float]:
    """A weight for every feature number (0 for those not chosen) and the constant."""
    spark: SparkSession = docs.sparkSession
    work = Workspace(spark, "toxic")
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(trainable(F.col("doc_id"))).where("doc_id is not null")
    ids = usable.select("doc_id").distinct()
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(trainable(F.col("doc_id")))
    marks = work.keep(marks.join(ids, "doc_id", "left_semi"), "marks")
    found = marks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("toxic").cast("int")), F.lit(0)).alias("p")).first()
    if not found["p"]:
        return constant(-40.0)
    prior = min(max(found["p"] / found["n"], 1 / (found["n"] + 2)), (found["n"] + 1) / (found["n"] + 2))
    yes = bounded_sample(marks.where("toxic = 1").select("doc_id"), MAX_POSITIVE).select("doc_id", F.lit(1).alias("is_p"))
    any_ = bounded_sample(ids, MAX_UNLABELLED).select("doc_id", F.lit(0).alias("is_p"))
    picked = work.keep(yes.unionByName(any_), "picked")
    # the sampled texts once, for both passes over them
    sampled = work.keep(usable.join(F.broadcast(picked), "doc_id"), "sampled")
    rows = work.keep(feature_rows(sampled), "rows")
    n = {r["is_p"]: r["n"] for r in rows.groupBy("is_p").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = n.get(1, 0), n.get(0, 0)
    if not n_p:
        return constant(-40.0)
    seen = rows.select("is_p", F.explode("features").alias("f")).groupBy("f").agg(F.sum("is_p").alias("p"), F.count("*").alias("all"))
    rate_p, rate_u = F.col("p") / n_p, (F.col("all") - F.col("p")) / max(1, n_u)
    pooled = F.col("all") / (n_p + n_u)
    gap = (rate_p - rate_u) / F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / max(1, n_u)) + 1e-12)
    best = seen.where((F.col("p") >= 3) & (rate_p * prior >= PURITY * rate_u)).select("f", gap.alias("z")).where("z > 3").orderBy(F.desc("z"), "f").limit(FEATURES).collect()
    chosen = np.array(sorted(r["f"] for r in best), np.int64)
    frame = feature_rows(sampled, spark.sparkContext.broadcast(chosen)).toPandas()
    w, b = fit([np.asarray(x, np.int64) for x in frame["features"]], frame["is_p"].to_numpy() == 1, prior, len(chosen))
    weights = np.zeros(1 << BITS, np.float32)
    weights[chosen] = w
    return weights, b


def score(docs: DataFrame, weights: np.ndarray, b: float) -> DataFrame:
    """doc_id, score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = held.value
        for batch in batches:
            z = np.full(batch.num_rows, b)
            for first, bounds, h, start, end, hash_of in tokens(batch.column(1), "alnum"):
                f = piece_features(h, start, end, hash_of)
                kind, at = np.nonzero(w[f])
                row = first + np.searchsorted(bounds, at, "right") - 1
                pair = np.unique(row * (1 << BITS) + f[kind, at])
                np.add.at(z, pair >> BITS, w[pair & ((1 << BITS) - 1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(z))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    weights, b = train(docs, labels, lambda c: crc_mod(c, modulus) != held)
    out = score(docs, weights, b)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
