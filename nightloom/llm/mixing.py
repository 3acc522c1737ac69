"""Mixing sources to target weights by entropy balancing.

Targets: sources in code-point order (null last) weigh 5, 2, 1, 5, ...; together they share
``TOTAL`` times the words of all documents. A target stops at ``CAP`` times its source's size and the
excess is shared again by weight until none is above.

Rates: every document i of n words gets a rate r, at most CAP. Of all rates that meet the token
constraints, those with the least relative entropy to "every document once",

    sum of v (r log r - r + 1),    v = n / u,  u = 1 + log n,

are taken. Constraints: the tokens of each source, sum of n r, equal its target; and the tokens of each
length band (a factor of 8 in words) keep the band's share of all words, softly (a penalty of SOFT on
their multipliers, since targets can make that impossible). The dual is convex; its rates are exponential
tilts r = min(CAP, exp(u (a + b))) with a multiplier a for the source and b for the band, so that
documents of one source differ by length.

Newton's iterations solve the dual over the cells (source, size), a complete and distributed
summary of the documents. Each aggregates per source the gradient, the Hessian's diagonal and its products
with the bands; eliminating the sources leaves a system of BANDS unknowns, whose sums are
aggregated over all sources and which alone reaches the driver. Steps are halved until the dual falls.

Copies: a rate becomes floor or ceiling copies. Within a source, documents are counted by (size,
hash bucket), with at most about BUCKET documents in each; going from large to small sizes, each
bucket takes as many ceilings as bring the running total closest to the rates' total, so a source
(or a shard of it, for very many buckets) ends within half its smallest document of its target.
Which documents of a bucket get the ceiling is decided by a hash of doc_id: reruns agree.

Defined results: null text has size 0 and takes 0. An empty table gives an empty result. Repeated rows
are documents of their own; of rows equal in doc_id and text, it is not defined which one takes more
copies. Very long texts count whole, in the last band. The number of sources is not bounded: nothing of
them is gathered.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, documents, free_name, maybe_broadcast, numbered, same_row, text_key, whole_rows, word_count

WEIGHTS, TOTAL, CAP = (5, 2, 1), 1.5, 2
BUCKET, SHARD = 1000, 100_000
#: Length bands: 1 to 7 words, 8 to 63, and so on; the last one is open.
BANDS, SOFT, STEPS, EXACT = 6, 0.05, 40, 1e-9


def targets(sources: DataFrame, work: Workspace, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """src, source_size, target: from (src, source_size); src is empty for the null source, else "=" and its name."""
    ranked = numbered(sources, [F.col("src") == "", F.col("src")], work, "sources")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("number", F.lit(len(weights))).cast("int") + 1)
    weighed = work.keep(ranked.select("src", "source_size", weight.alias("weight")), "weights")
    level, last = 0.0, None
    while True:
        # what lies above its cap at this level stops there, the others share the rest
        full = F.col("weight") * level > cap * F.col("source_size")
        seen = weighed.agg(F.count(F.when(full, 1)).alias("full"), F.sum("source_size").alias("all"), F.sum(F.when(full, cap * F.col("source_size")).otherwise(0.0)).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if not seen["weight"] or seen["full"] == last:
            break
        level, last = (total * seen["all"] - seen["taken"]) / seen["weight"], seen["full"]
    return work.keep(weighed.select("src", "source_size", F.least(F.col("weight") * level, F.lit(float(cap)) * F.col("source_size")).alias("target")), "targets")


def band_of(size) -> Column:
    return F.least(F.floor(F.log2(size) / 3 + 1e-9), F.lit(BANDS - 1)).cast("int")


def price(size) -> Column:
    return 1 + F.log(size)


def rate_of(size, alpha, beta: list[float], cap: float) -> Column:
    """The tilted rate of a document; alpha is null for sources whose every document stands at the cap."""
    band = F.element_at(F.array(*(F.lit(float(b)) for b in beta)), band_of(size) + 1)
    return F.when(alpha.isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(price(size) * (alpha + band))))


def evaluated(cells: DataFrame, state: DataFrame, beta: list[float], cap: float) -> DataFrame:
    """By source: tokens and curvature by band, and the dual's first sum, at (src, target, alpha)."""
    t = price("size") * (F.col("alpha") + F.element_at(F.array(*(F.lit(float(b)) for b in beta)), F.col("band") + 1))
    bent = F.col("alpha").isNotNull() & (t < math.log(cap))
    words = F.col("n") * F.col("size")
    rated = cells.join(state, "src").select("src", "target", "alpha", "band", bent.alias("bent"), (words * rate_of(F.col("size"), F.col("alpha"), beta, cap)).alias("tokens"), price("size").alias("u"), (F.when(F.col("alpha").isNull(), 0.0).when(bent, words / price("size") * F.exp(t)).otherwise(words / price("size") * cap * (1 + t - math.log(cap)))).alias("cost"))
    of = lambda k, x: F.sum(F.when(F.col("band") == k, x).otherwise(0.0))
    curve = F.when(F.col("bent"), F.col("tokens") * F.col("u")).otherwise(0.0)
    sums = [*(of(k, F.col("tokens")).alias(f"t{k}") for k in range(BANDS)), *(of(k, curve).alias(f"h{k}") for k in range(BANDS))]
    return rated.groupBy("src").agg(F.first("target").alias("target"), F.first("alpha").alias("alpha"), F.sum("cost").alias("cost"), *sums)


def tilt(cells: DataFrame, goals: DataFrame, work: Workspace, cap: float = CAP, steps: int = STEPS) -> tuple[DataFrame, list[float]]:
    """src, alpha (null: all at the cap) and the bands' multipliers, by Newton's iterations on the dual.

    cells: src, size, band, n; goals: src, source_size, target.
    """
    band_words = {r["band"]: float(r["words"]) for r in cells.groupBy("band").agg(F.sum(F.col("n") * F.col("size")).alias("words")).collect()}
    every = sum(band_words.values())
    if not every:
        return goals.select("src", F.lit(None).cast("double").alias("alpha")), [0.0] * BANDS
    asked = goals.agg(F.sum("target").alias("t"), F.count("*").alias("n")).first()
    goal = np.array([band_words.get(k, 0.0) / every * asked["t"] for k in range(BANDS)])
    soft = SOFT * np.maximum(goal, 1.0)
    few = F.broadcast if asked["n"] <= 100_000 else (lambda df: df)
    # the start: rates that would be right if all prices were the source's mean
    mean = cells.groupBy("src").agg((F.sum(F.col("n") * F.col("size") * price("size")) / F.sum(F.col("n") * F.col("size"))).alias("mean"))
    bound = F.col("target") < F.col("source_size") * cap * (1 - 1e-12)
    state = goals.where("target > 0").join(few(mean), "src").select("src", "target", F.when(bound, F.log(F.col("target") / F.col("source_size")) / F.col("mean")).alias("alpha"))
    state = work.keep(state, "start")
    beta, best, base, step = np.zeros(BANDS), None, None, 1.0
    curve = lambda: sum((F.col(f"h{k}") for k in range(1, BANDS)), F.col("h0"))
    open_ = F.col("alpha").isNotNull()
    for k in range(steps):
        now = work.keep(evaluated(cells, few(state), beta.tolist(), cap), f"newton{k}")
        slope = sum((F.col(f"t{i}") for i in range(1, BANDS)), F.col("t0")) - F.col("target")
        total = F.greatest(curve(), 1e-9 * F.col("target"))
        pairs = [(i, j) for i in range(BANDS) for j in range(i, BANDS)]
        got = now.agg(
            F.sum(F.col("cost") - F.when(open_, F.col("alpha") * F.col("target")).otherwise(0.0)).alias("dual"), F.max(F.when(open_, F.abs(slope) / F.col("target"))).alias("worst"),
            *(F.sum(f"t{i}").alias(f"t{i}") for i in range(BANDS)), *(F.sum(F.when(open_, F.col(f"h{i}"))).alias(f"h{i}") for i in range(BANDS)),
            *(F.sum(F.when(open_, F.col(f"h{i}") * slope / total)).alias(f"g{i}") for i in range(BANDS)), *(F.sum(F.when(open_, F.col(f"h{i}") * F.col(f"h{j}") / total)).alias(f"q{i}_{j}") for i, j in pairs),
        ).first()
        get = lambda name: np.array([got[f"{name}{i}"] or 0.0 for i in range(BANDS)])
        # tokens of the sources at the cap are constants of the bands' gradient; their cost was left out
        fixed = now.where(~open_).agg(*(F.sum(f"t{i}").alias(f"t{i}") for i in range(BANDS))).first() if k == 0 else fixed
        still = np.array([fixed[i] or 0.0 for i in range(BANDS)])
        dual = (got["dual"] or 0.0) + float(still @ beta - goal @ beta + 0.5 * soft @ beta**2)
        if best is not None and dual > best + 1e-12 * abs(best) and step > 1e-3:
            step /= 2
        else:
            away = get("t") - goal + soft * beta
            if max(got["worst"] or 0.0, float(np.abs(away / np.maximum(goal, 1.0)).max())) < EXACT:
                return now.select("src", "alpha"), beta.tolist()
            schur = np.diag(get("h") + soft)
            for i, j in pairs:
                schur[i, j] -= got[f"q{i}_{j}"] or 0.0
                schur[j, i] = schur[i, j]
            best, base, step = dual, (now, beta, -np.linalg.solve(schur, away - get("g"))), 1.0
        there, b0, move = base
        beta = b0 + step * move
        shift = slope + sum((F.col(f"h{i}") * float(move[i]) for i in range(1, BANDS)), F.col("h0") * float(move[0]))
        state = there.select("src", "target", (F.col("alpha") - step * shift / total).alias("alpha"))
    return state.select("src", "alpha"), beta.tolist()


def ceilings(frame: pd.DataFrame) -> pd.DataFrame:
    """For applyInPandas over the buckets of a shard: how many documents of each get the ceiling."""
    frame = frame.sort_values(["size", "bucket"], ascending=[False, True], kind="stable")
    owed, out = 0.0, []
    for size, n, rate in zip(frame["size"], frame["n"], frame["rate"]):
        low = math.floor(rate)
        owed += (rate - low) * size * n
        k = int(min(n, max(0, math.floor(owed / size + 0.5)))) if rate > low else 0
        owed -= k * size
        out.append(k)
    return frame.assign(ceil=np.array(out, np.int64))[["src", "size", "bucket", "ceil"]]


def rated_rows(docs: DataFrame, work: Workspace) -> DataFrame:
    """doc_id, row, src, size, source_size, target and rate of every row."""
    src = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    sized = work.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), src.alias("src"), word_count().alias("size"), text_key().alias("row")), "sizes")
    cells = sized.where("size > 0").groupBy("src", "size").agg(F.count("*").alias("n")).withColumn("band", band_of("size"))
    cells = work.keep(cells, "cells")
    goals = targets(sized.groupBy("src").agg(F.sum("size").alias("source_size")), work)
    multipliers, beta = tilt(cells, goals, work)
    plan = maybe_broadcast(work.keep(goals.join(multipliers, "src", "left"), "plan"))
    # rounded, so that reruns whose sums differ in the last bits agree
    rate = F.when((F.col("size") == 0) | (F.col("target") <= 0), F.lit(0.0)).otherwise(F.round(rate_of(F.col("size"), F.col("alpha"), beta, CAP), 9))
    return sized.join(plan, "src").withColumn("rate", rate).drop("alpha")


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, row, size, source_size, target, rate, copies, taken of every row."""
    work = Workspace(docs.sparkSession, "mix")
    rated = rated_rows(docs, work)
    order = F.xxhash64(F.lit("copies"), F.col("doc_id").cast("string"))
    crowd = rated.where("size > 0").groupBy("src", "size").agg(F.count("*").alias("docs"))
    parts = maybe_broadcast(work.keep(crowd.where(F.col("docs") > BUCKET).select(F.col("src").alias("s2"), F.col("size").alias("z2"), F.ceil(F.col("docs") / BUCKET).alias("parts")), "crowds"))
    placed = rated.where("size > 0").join(parts, (F.col("src") == F.col("s2")) & (F.col("size") == F.col("z2")), "left").withColumn("order", order)
    placed = work.keep(placed.withColumn("bucket", F.pmod("order", F.coalesce("parts", F.lit(1)))).drop("s2", "z2", "parts"), "placed")
    buckets = placed.groupBy("src", "size", "bucket", "rate").agg(F.count("*").alias("n"))
    shards = buckets.groupBy("src").agg(F.ceil(F.count("*") / SHARD).alias("shards"))
    dealt = buckets.join(shards, "src").withColumn("shard", F.pmod(F.xxhash64("size", "bucket"), F.col("shards")))
    ceil = dealt.groupBy("src", "shard").applyInPandas(ceilings, "src string, size long, bucket long, ceil long")
    best = Window.partitionBy("src", "size", "bucket").orderBy("order", "row")
    chosen = placed.withColumn("rank", F.row_number().over(best)).join(ceil, ["src", "size", "bucket"])
    copies = (F.floor("rate") + (F.col("rank") <= F.col("ceil")).cast("long")).cast("long")
    chosen = chosen.select("doc_id", "row", "size", "source_size", "target", "rate", copies.alias("copies"))
    none = rated.where("size = 0").select("doc_id", "row", "size", "source_size", "target", "rate", F.lit(0).cast("long").alias("copies"))
    return chosen.unionByName(none).withColumn("taken", F.col("copies") * F.col("size"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the mix takes, with copies, source_size and target.

    Where docs has a column of such a name, the new one's name gets underscores. Rows equal in doc_id and
    text all get the copies of the one that takes most.
    """
    taken = mixed(docs).where("copies > 0").groupBy("doc_id", "row").agg(F.max("copies").alias("copies"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    taken = taken.withColumnsRenamed({"doc_id": "doc_id_", "row": "row_"})
    whole = whole_rows(docs)
    joined = whole.join(taken, same_row(whole, taken))
    return joined.select("doc.*", *(F.col(c).alias(free_name(docs.columns, c)) for c in ("copies", "source_size", "target")))


QUERIES = {"op7_mix_sources": op7_mix_sources}
ORACLES: dict[str, str] = {}
