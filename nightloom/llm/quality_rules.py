"""Quality rules: base rules, then robust multivariate outliers by language and source.

Everything here is a DataFrame or SQL expression.

Base: counts over the whole text (see ``base_counts``). A text fails with fewer than 10 words, or
if over 20 % of its words lie in five-word windows that the text holds twice or more.

Outliers: five transformed statistics per text (``transformed``) that pass the base rules. For each
(lang, source) a minimum-covariance-determinant estimate over the ``SUPPORT`` share of texts. It is
searched from three deterministic starts: the group's medians and median deviations without
correlations; the same with the correlations of the statistics' hyperbolic tangents, which outliers
hardly move; and the mean and covariance of all texts. Concentration steps take the texts with the least
Mahalanobis distance and re-estimate mean and covariance from them, which never raises the
determinant. After ``FIRST_STEPS`` steps the start with the least determinant stays, and goes on until no
group's estimate moves (by ``STILL``). The covariance is scaled to be consistent at the normal distribution.
Where a statistic hardly varies in the support (symbols, repeated lines and words are mostly 0) its
variance is raised to ``LEAST_VARIANCE`` over the count it is measured on, at the support's geometric
mean: for a share, the sampling variance of its angle. Any other variance stays as estimated. Texts
whose squared distance exceeds the chi-square quantile ``QUANTILE`` are rejected.

A covariance of five statistics needs ``LEAST`` texts, ten for each. Groups with fewer are pooled by
language, and languages that stay under it are pooled into one group; a pool under it rejects none.

Sums run over statistics rounded to 1/4096 as exact decimals and supports are cut at whole
histogram bins, so the verdicts do not depend on the order of rows. A group is never gathered:
every step is a pre-aggregated sum or histogram.

Defined results: null text counts as empty and fails. Null lang or source is a group of its own.
Repeated rows count as often as they occur; starts of equal determinant go in the order above. Very
long texts are counted whole. An empty table gives an empty result. Rows are told apart by (doc_id,
hash of the text); other columns, whatever their names, are kept by the stage.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, documents, few_tasks, maybe_broadcast, same_row, text_key, whole_rows

MIN_WORDS, MAX_REPEAT, WINDOW = 10, 20, 5
SUPPORT, QUANTILE, LEAST = 0.75, 0.9999, 50
#: Concentration ends when means move by under so many deviations and variances by under this share; MAX_STEPS guards against supports that alternate.
STILL, MAX_STEPS, FIRST_STEPS = 0.01, 50, 2
#: Least variances, times words, words, letters, lines and windows: log words, log word length, and three shares as angles.
LEAST_VARIANCE = (0.25, 0.0025, 0.25, 0.25, 0.25)
P = len(LEAST_VARIANCE)
#: Of correlations: so much of each variance is added, which keeps the inverse regular.
RIDGE = 1e-3
UNIT = 4096
SYMBOLS = "#*$%&|<>"


def chi_square(x: float, k: int) -> float:
    """The chi-square distribution function, by the series of the incomplete gamma function."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return total * math.exp(a * math.log(z) - z - math.lgamma(a)) if z > 0 else 0.0


def chi_square_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, k) < q else (lo, mid)
    return hi


def consistency(share: float, k: int) -> float:
    """What a covariance of the central `share` is multiplied by."""
    return share / chi_square(chi_square_quantile(share, k), k + 2)


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, also where lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words within windows of WINDOW words that occur twice or more."""

    def of(hashes: Column) -> Column:
        # windows in order of hash and place: those with an equal neighbour are repeated
        rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i"))))

        def places(a: Column) -> Column:
            twin = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda k: ((k > 0) & (F.get(a, k - 1)["h"] == F.get(a, k)["h"])) | (F.get(a, k + 1)["h"] == F.get(a, k)["h"]))
            return F.sort_array(F.transform(twin, lambda k: F.get(a, k)["i"]))

        def covered(p: Column) -> Column:
            start = F.struct(F.lit(-WINDOW).cast("int").alias("last"), F.lit(0).cast("int").alias("n"))
            return F.aggregate(p, start, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).cast("int").alias("n")))["n"]

        found = F.coalesce(covered(let(rows, places)), F.lit(0))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(found)

    def hashed(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))

    by_word = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(let(by_word, hashed), of))


def base_counts(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed (and `extra`).

    Words are `[^\\x20\\x09-\\x0D]+`; n_dup_lines counts lines with a word that equal an earlier line.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    words = F.filter(F.split(spaced, " "), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    long = lambda c: c.cast("long")
    out = docs.select(
        "doc_id", *extra,
        let(words, lambda w: F.struct(long(F.size(w)).alias("n_words"), long(repeated_words(w)).alias("n_repeat_words"))).alias("w"),
        long(F.length(F.translate(spaced, " ", ""))).alias("word_chars"),
        long(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        let(lines, lambda x: F.struct(long(F.size(x)).alias("n_lines"), long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("l"),
    )
    out = out.select("doc_id", *extra, "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def angle(part: Column, whole: Column) -> Column:
    """The variance-stabilising transform of a share."""
    return F.asin(F.sqrt(F.least(F.lit(1.0), part / F.greatest(whole, F.lit(1)))))


def transformed() -> list[Column]:
    """The five statistics and the log of lines in units of 1/UNIT, as whole numbers."""
    n, letters = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars"))
    raw = [F.log(n), F.log(letters / n), angle(F.col("n_symbols"), F.col("word_chars")), angle(F.col("n_dup_lines"), F.col("n_lines")), angle(F.col("n_repeat_words"), n)]
    raw.append(F.log(F.greatest(F.col("n_lines"), F.lit(1))))
    return [F.round(x * UNIT).cast("long").alias(f"x{i}") for i, x in enumerate(raw)]


def least_variances(log_words: Column, log_length: Column, log_lines: Column) -> list[Column]:
    counts = [log_words, log_words, log_words + log_length, log_lines, F.greatest(log_words - math.log(WINDOW), F.lit(0.0))]
    return [F.lit(v) * F.exp(-n) for v, n in zip(LEAST_VARIANCE, counts)]


def distance(mean: list[Column], inverse: list[list[Column]]) -> Column:
    """The squared Mahalanobis distance of x0.. from a mean."""
    d = [F.col(f"x{i}") / UNIT - m for i, m in enumerate(mean)]
    terms = [d[i] * d[j] * inverse[i][j] * (1 if i == j else 2) for i in range(P) for j in range(i, P)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def invert(df: DataFrame) -> DataFrame:
    """From columns c_i_j (i <= j) to v_i_j and logdet: Cholesky factor, its inverse and the product, unrolled."""
    at = lambda name, i, j: F.col(f"{name}_{max(i, j)}_{min(i, j)}")
    for j in range(P):
        square = F.col(f"c_{j}_{j}")
        for k in range(j):
            square = square - at("l", j, k) * at("l", j, k)
        df = df.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(square, F.lit(1e-12))))
        rest = {}
        for i in range(j + 1, P):
            x = F.col(f"c_{j}_{i}")
            for k in range(j):
                x = x - at("l", i, k) * at("l", j, k)
            rest[f"l_{i}_{j}"] = x / at("l", j, j)
        df = df.withColumns(rest) if rest else df
    for i in range(P):
        row = {f"m_{i}_{i}": 1 / at("l", i, i)}
        for j in range(i):
            x = F.lit(0.0)
            for k in range(j, i):
                x = x - at("l", i, k) * at("m", k, j)
            row[f"m_{i}_{j}"] = x / at("l", i, i)
        df = df.withColumns(row)
    out = {}
    for i in range(P):
        for j in range(i, P):
            x = F.lit(0.0)
            for k in range(j, P):
                x = x + at("m", k, i) * at("m", k, j)
            out[f"v_{i}_{j}"] = x
    out["logdet"] = sum((2 * F.log(at("l", i, i)) for i in range(1, P)), 2 * F.log(at("l", 0, 0)))
    return df.withColumns(out)


def share_cut(values: DataFrame, bin_: Column, share: float, name: str, *keys: str) -> DataFrame:
    """By group: the least bin up to which at least `share` of the rows lie, in a column `name`."""
    hist = values.groupBy(*keys, bin_.alias("b")).agg(F.count("*").alias("n"))
    # bins of a group: bounded by the statistic's range, whatever the number of rows
    packed = hist.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("b", "n"))).alias("h"), F.sum("n").alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("cut"))

    def step(s: Column, x: Column) -> Column:
        seen = s["seen"] + x["n"]
        return F.struct(seen.alias("seen"), F.when(s["cut"].isNull() & (seen >= F.col("all") * share), x["b"].cast("long")).otherwise(s["cut"]).alias("cut"))

    return packed.select(*keys, F.aggregate("h", start, step)["cut"].alias(name))


def starting(stats: DataFrame, work: Workspace) -> DataFrame:
    """The three starts of each group g, as groups g#0, g#1 and g#2."""
    single = stats.select("g", F.posexplode(F.array(*(F.col(f"x{i}") / UNIT for i in range(P + 1)))).alias("i", "x"))
    middle = share_cut(single, F.floor(F.col("x") * 64), 0.5, "b", "g", "i").select("g", "i", ((F.col("b") + 0.5) / 64).alias("mu"))
    middle = maybe_broadcast(work.keep(middle, "medians"))
    spread = share_cut(single.join(middle, ["g", "i"]), F.floor(F.abs(F.col("x") - F.col("mu")) * 64), 0.5, "b", "g", "i")
    both = middle.join(spread, ["g", "i"]).withColumn("s", 1.4826 * (F.col("b") + 0.5) / 64)
    pick = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    wide = both.groupBy("g").agg(*(pick("mu", i).alias(f"mu_{i}") for i in range(P + 1)), *(pick("s", i).alias(f"s_{i}") for i in range(P)))
    least = least_variances(F.col("mu_0"), F.col("mu_1"), F.col(f"mu_{P}"))
    wide = wide.withColumns({f"s_{i}": F.sqrt(F.greatest(F.col(f"s_{i}") * F.col(f"s_{i}"), least[i])) for i in range(P)})
    wide = maybe_broadcast(work.keep(few_tasks(wide), "spreads"))
    plain = {f"c_{i}_{j}": F.col(f"s_{i}") * F.col(f"s_{i}") if i == j else F.lit(0.0) for i in range(P) for j in range(i, P)}
    # tangents as whole numbers, so that their sums are exact
    bent = stats.join(wide, "g").select("g", *(F.round(F.tanh((F.col(f"x{i}") / UNIT - F.col(f"mu_{i}")) / F.col(f"s_{i}")) * UNIT).cast("long").alias(f"y{i}") for i in range(P)))
    sums = bent.groupBy("g").agg(F.count("*").alias("n"), *(F.sum(f"y{i}").alias(f"t_{i}") for i in range(P)), *(F.sum(F.col(f"y{i}") * F.col(f"y{j}")).alias(f"u_{i}_{j}") for i in range(P) for j in range(i, P)))
    both = wide.join(sums, "g")
    cov = lambda i, j: F.col(f"u_{i}_{j}") / F.col("n") - F.col(f"t_{i}") / F.col("n") * F.col(f"t_{j}") / F.col("n")
    related = {f"c_{i}_{j}": F.col(f"s_{i}") * F.col(f"s_{j}") * (F.lit(1 + RIDGE) if i == j else F.coalesce(F.try_divide(cov(i, j), F.sqrt(F.greatest(cov(i, i) * cov(j, j), F.lit(1e-9)))), F.lit(0.0))) for i in range(P) for j in range(i, P)}
    starts = [invert(wide.withColumns(plain)), invert(both.withColumns(related)), moments(stats, 1.0)]
    named = [df.withColumn("g", F.concat("g", F.lit(f"#{k}"))).select(*estimate_columns()) for k, df in enumerate(starts)]
    return named[0].unionByName(named[1]).unionByName(named[2])


def least_determinant(estimate: DataFrame) -> DataFrame:
    """Of the starts of each group the one with the least determinant, under the group's own name."""
    own = estimate.withColumn("of", F.expr("substring(g, 1, length(g) - 2)"))
    rest = [c for c in estimate_columns() if c != "g"]
    best = own.groupBy("of").agg(F.min(F.struct(F.round("logdet", 9).alias("key"), "g", *rest)).alias("e"))
    return best.select(F.col("of").alias("g"), *(F.col(f"e.{c}").alias(c) for c in rest))


def estimate_columns() -> list[str]:
    """The group, its mean and inverse covariance, and the covariance's log determinant."""
    return ["g", "logdet", *(f"mu_{i}" for i in range(P)), *(f"v_{i}_{j}" for i in range(P) for j in range(i, P))]


def measured(stats: DataFrame, estimate: DataFrame, hint, how: str = "inner") -> DataFrame:
    inverse = [[F.col(f"v_{min(i, j)}_{max(i, j)}") for j in range(P)] for i in range(P)]
    return stats.join(hint(estimate), "g", how).withColumn("d2", distance([F.col(f"mu_{i}") for i in range(P)], inverse))


def concentrated(stats: DataFrame, estimate: DataFrame, hint) -> DataFrame:
    """One concentration step: mean and inverse covariance of the closest SUPPORT share."""
    near = measured(stats, estimate, hint).withColumn("bin", F.floor(F.log1p(F.least(F.col("d2"), F.lit(1e9))) * 256))
    cut = share_cut(near, F.col("bin"), SUPPORT, "cut", "g")
    return moments(near.join(hint(cut), "g").where("bin <= cut"), consistency(SUPPORT, P))


def moments(inside: DataFrame, scale: float) -> DataFrame:
    """By group: the mean and the scaled covariance of the rows, inverted."""
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    sums = [F.count("*").alias("n"), *(exact(F.col(f"x{i}")).alias(f"s_{i}") for i in range(P + 1)), *(exact(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q_{i}_{j}") for i in range(P) for j in range(i, P))]
    got = inside.groupBy("g").agg(*sums)
    n = F.col("n").cast("double")
    mean = {f"mu_{i}": F.col(f"s_{i}").cast("double") / n / UNIT for i in range(P + 1)}
    got = got.withColumns(mean)
    least = least_variances(F.col("mu_0"), F.col("mu_1"), F.col(f"mu_{P}"))
    cov = {}
    for i in range(P):
        for j in range(i, P):
            c = (F.col(f"q_{i}_{j}").cast("double") / n / (UNIT * UNIT) - F.col(f"mu_{i}") * F.col(f"mu_{j}")) * scale
            cov[f"c_{i}_{j}"] = F.greatest(c, least[i]) * (1 + RIDGE) if i == j else c
    return invert(got.withColumns(cov)).select(*estimate_columns())


def moved(old: DataFrame, new: DataFrame) -> bool:
    """Whether any group's estimate moved by more than STILL."""
    both = new.join(old.select("g", *(F.col(c).alias(f"old_{c}") for c in estimate_columns()[2:])), "g")
    means = [F.abs(F.col(f"mu_{i}") - F.col(f"old_mu_{i}")) * F.sqrt(F.col(f"v_{i}_{i}")) for i in range(P)]
    spreads = [F.abs(F.col(f"v_{i}_{i}") / F.col(f"old_v_{i}_{i}") - 1) for i in range(P)]
    return (both.agg(F.max(F.greatest(*means, *spreads)).alias("most")).first()["most"] or 0.0) > STILL


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row,

    and row, a hash that tells texts of one doc_id apart."""
    spark: SparkSession = docs.sparkSession
    work = Workspace(spark, "quality")
    source = docs.select("doc_id", "text", *(F.col(c).cast("string").alias(c) for c in ("lang", "source")), text_key().alias("row"))
    counts = work.keep(base_counts(source, "lang", "source", "row"), "counts")
    fit = counts.where("not base_failed").select("lang", "source", *transformed())
    # groups: (lang, source), else the language's small sources, else all small languages
    sizes = fit.groupBy("lang", "source").agg(F.count("*").alias("n"))
    pool = F.sum(F.when(F.col("n") < LEAST, F.col("n"))).over(Window.partitionBy("lang"))
    sizes = sizes.withColumn("pool", F.coalesce(pool, F.lit(0)))
    name = F.when(F.col("n") >= LEAST, F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})).when(F.col("pool") >= LEAST, F.to_json(F.array("lang"))).otherwise("[]")
    groups = maybe_broadcast(work.keep(sizes.select("lang", "source", name.alias("g")), "groups"))
    grouped = counts.alias("t").join(groups.select(F.col("lang").alias("gl"), F.col("source").alias("gs"), "g"), F.col("t.lang").eqNullSafe(F.col("gl")) & F.col("t.source").eqNullSafe(F.col("gs")), "left").drop("gl", "gs", "lang", "source")
    whole = work.keep(grouped.select("*", *transformed()), "stats")
    stats = whole.where("not base_failed").select("g", *(f"x{i}" for i in range(P + 1)))
    # one row a group: whether that is broadcast is decided once for all steps
    few = groups.count() <= 100_000
    hint = lambda df: F.broadcast(df) if few else df
    estimate = work.keep(few_tasks(starting(stats, work)), "starts")
    tried = stats.withColumn("g", F.explode(F.array(*(F.concat("g", F.lit(f"#{k}")) for k in range(3)))))
    for step in range(FIRST_STEPS):
        estimate = work.keep(few_tasks(concentrated(tried, estimate, hint)), f"first{step}")
    estimate = work.keep(few_tasks(least_determinant(estimate)), "best")
    for step in range(MAX_STEPS):
        last, estimate = estimate, work.keep(few_tasks(concentrated(stats, estimate, hint)), f"step{step + 1}")
        if not moved(last, estimate):
            break
    enough = stats.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") >= LEAST).select("g")
    estimate = work.keep(few_tasks(estimate.join(enough, "g", "left_semi")), "final")
    limit = chi_square_quantile(QUANTILE, P)
    judged = measured(whole, estimate, hint, "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= limit, F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "row")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).drop("row")


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go."""
    good = quality_rules(docs).where("kept").select(F.col("row").alias("row_"), F.col("doc_id").cast("long").alias("doc_id_")).distinct()
    whole = whole_rows(docs)
    return whole.join(good, same_row(whole, good), "left_semi").select("doc.*")


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES: dict[str, str] = {}
