"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

1. Random indexing over all documents: a word's vector is the sum of its neighbours' index vectors
   (two words on either side); an index vector has one signed entry for the neighbour and one
   for its last two bytes. Words and word endings share BUCKETS hashed rows of whole numbers, so
   sums are exact and the table has a fixed size.
2. Rows are log-scaled, centred and brought to unit length.
3. A document is pooled over all its words: mean and spread of the vectors, weighted down for
   frequent rows, the mean product of adjacent vectors, and the logarithm of its length.
4. A two-layer network in numpy learns labels.quality from up to MAX_LABELLED rows of which
   ``crc32(doc_id as text) mod 5`` is not 0; a fifth of them is set aside to fit the temperature
   that its probabilities are calibrated with.

Defined results: null and empty texts pool to zeros and are scored like any other. Conflicting
labels of one doc_id: the lower counts; labels of null doc_ids or without a document are left out. With
under LEAST_LABELLED labelled rows, or labels of one kind only, every score is the share of label 1 among
them, one row of each kind added; without labels that is 0.5. Very long texts are pooled whole; rows that
repeat are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bounded_sample, crc_mod, documents, mix, sized_tasks, table, tokens

MAX_LABELLED, LEAST_LABELLED, HIDDEN, EPOCHS, THRESHOLD = 20_000, 10, 32, 60, 0.3
BUCKETS, DIM, TASK_BYTES = 1 << 15, 32, 32 << 20
POOLED = 2 * DIM + 2


def rows_of(h: np.ndarray, start: np.ndarray, end: np.ndarray, hash_of) -> tuple[np.ndarray, np.ndarray]:
    """The table rows of each word and of its ending."""
    tail = hash_of(np.maximum(start, end - 2), end) * np.uint64(5)
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64), (mix(tail) & np.uint64(BUCKETS - 1)).astype(np.int64)


def index_vectors(docs: DataFrame) -> np.ndarray:
    """The summed table: BUCKETS rows of DIM whole numbers, and each row's count."""
    names = [f"c{i}" for i in range(DIM + 1)]

    def run(batches):
        total = np.zeros(BUCKETS * DIM, np.int64)
        count = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, bounds, h, start, end, hash_of in tokens(batch.column(0), "space", fold=False):
                if not len(h):
                    continue
                word, tail = rows_of(h, start, end, hash_of)
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                count += np.bincount(word, minlength=BUCKETS) + np.bincount(tail, minlength=BUCKETS)
                entries = []
                for salt, key in ((1, word), (2, tail)):
                    r = mix(key.astype(np.uint64) * np.uint64(2) + np.uint64(salt))
                    entries.append(((r % np.uint64(DIM)).astype(np.int64), np.where(r >> np.uint64(63), 1.0, -1.0)))
                for away in (1, 2):
                    if len(h) <= away:
                        continue
                    same = doc[away:] == doc[:-away]
                    left, right = np.flatnonzero(same), np.flatnonzero(same) + away
                    for a, b in ((left, right), (right, left)):
                        for row in (word, tail):
                            for dim, sign in entries:
                                total += np.bincount(row[a] * DIM + dim[b], sign[b], minlength=BUCKETS * DIM).astype(np.int64)
        grid = total.reshape(BUCKETS, DIM)
        used = np.flatnonzero(count)
        for i in range(0, len(used), 4096):
            part = used[i : i + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(np.ascontiguousarray(grid[part, k])) for k in range(DIM)), pa.array(count[part])], ["row", *names])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = sized_tasks(texts, size, TASK_BYTES).mapInArrow(run, "row long, " + ", ".join(f"{n} long" for n in names))
    summed = parts.groupBy("row").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
    out = np.zeros((BUCKETS, DIM + 1))
    out[summed["row"].to_numpy()] = summed[names].to_numpy()
    return out


def unit_rows(table_: np.ndarray) -> np.ndarray:
    """float32 rows of unit length, with each row's weight as a last column."""
    v = np.sign(table_[:, :-1]) * np.log1p(np.abs(table_[:, :-1]))
    used = table_[:, -1] > 0
    if used.any():
        v[used] -= v[used].mean(0)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    share = table_[:, -1:] / max(1.0, table_[:, -1].sum())
    return np.concatenate([np.where(used[:, None], v, 0), 1e-3 / (1e-3 + share)], axis=1).astype(np.float32)


def pooled(column, vectors: np.ndarray) -> np.ndarray:
    """One row of POOLED numbers for every text."""
    out = np.zeros((len(column), POOLED), np.float32)
    for first, bounds, h, start, end, hash_of in tokens(column, "space", fold=False):
        if not len(h):
            continue
        word, tail = rows_of(h, start, end, hash_of)
        w, t = vectors[word], vectors[tail]
        weight = np.maximum(w[:, -1:], 0.05)
        x = (w[:, :-1] + t[:, :-1]) / 2
        near = np.zeros(len(h), np.float32)
        near[:-1] = (x[:-1] * x[1:]).sum(1)
        has = np.flatnonzero(np.diff(bounds))
        at = bounds[has]
        near[bounds[has + 1] - 1] = 0  # no neighbour beyond the text
        n = np.diff(bounds)[has][:, None]
        total = np.add.reduceat(weight, at)
        mean = np.add.reduceat(x * weight, at) / total
        square = np.add.reduceat(x * x * weight, at) / total
        rest = np.concatenate([np.add.reduceat(near, at)[:, None] / n, np.log1p(n) / 10], 1)
        out[first + has] = np.concatenate([mean * 4, np.sqrt(np.maximum(square - mean**2, 0)) * 4, rest], 1)
    return out


def network(x: np.ndarray, y: np.ndarray) -> tuple:
    """Two layers (tanh, then logistic), Adam over small batches; scaled inputs; temperature."""
    rng = np.random.default_rng(7)
    aside = np.arange(len(x)) % 5 == 0
    mean, scale = x[~aside].mean(0), x[~aside].std(0) + 1e-3
    z = (x - mean) / scale
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    fit = np.flatnonzero(~aside)
    for epoch in range(EPOCHS):
        order = rng.permutation(fit)
        for i in range(0, len(order), 128):
            rows = order[i : i + 128]
            hidden = np.tanh(z[rows] @ p[0] + p[1])
            off = 1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -40, 40))) - y[rows]
            back = off[:, None] * p[2] * (1 - hidden**2)
            grads = [z[rows].T @ back / len(rows) + 1e-4 * p[0], back.mean(0), hidden.T @ off / len(rows) + 1e-4 * p[2], np.array([off.mean()])]
            t += 1
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 3e-3 * (1 - epoch / EPOCHS) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    logit = np.tanh(z[aside] @ p[0] + p[1]) @ p[2] + p[3]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
    loss = [np.logaddexp(0, -np.where(y[aside] > 0, 1, -1) * logit / g).mean() for g in grid]
    return mean, scale, *p, float(grid[int(np.argmin(loss))])


def probability(x: np.ndarray, model: tuple) -> np.ndarray:
    mean, scale, w1, b1, w2, b2, temperature = model
    z = np.tanh(((x - mean) / scale) @ w1 + b1) @ w2 + b2
    return 1 / (1 + np.exp(-np.clip(z / temperature, -40, 40)))


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    work = Workspace(spark, "qualitymodel")
    vectors = spark.sparkContext.broadcast(unit_rows(index_vectors(docs)))
    usable = crc_mod(F.col("doc_id"), modulus) != held
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(usable)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = marks.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = work.keep(bounded_sample(marks, MAX_LABELLED), "picked")

    def features(batches):
        for batch in batches:
            x = pooled(batch.column(1), vectors.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), POOLED).cast(pa.list_(pa.float32()))], ["doc_id", "quality", "x"])

    frame = texts.join(picked, "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInArrow(features, "doc_id long, quality int, x array<float>").toPandas().sort_values("doc_id", kind="stable")
    model, share = None, (float((frame["quality"] > 0).sum()) + 1) / (len(frame) + 2)
    if len(frame) >= LEAST_LABELLED and frame["quality"].nunique() > 1:
        model = network(np.stack(frame["x"]).astype(np.float64), frame["quality"].to_numpy(np.float64))

    def run(batches):
        for batch in batches:
            x = pooled(batch.column(1), vectors.value)
            p = probability(x, model) if model else np.full(len(x), share)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.asarray(p, np.float64))], ["doc_id", "score"])

    scored = texts.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES = {"op9_quality_model": op9_quality_model}
ORACLES: dict[str, str] = {}
