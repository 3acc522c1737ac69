"""The text operators against brute force on small fixtures, with nulls, ties, repeats and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from nightloom.llm import common, decontaminate, html_extract, language_model, license_scan, line_dedup, mixing, near_dedup, quality_model, quality_rules, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def prose(n, seed):
    w = words(n, seed)
    return "\n".join(" ".join(w[i : i + 30]) for i in range(0, n, 30))


@pytest.fixture(scope="module")
def texts():
    base = prose(120, 1)
    near = base.replace("\n", " x ", 1)
    shared = " ".join(words(60, 99))
    out = [base, base, near, "", None, "one", "  \n ", prose(3000, 2), f"{prose(40, 3)}\n{shared}\n{prose(40, 4)}", f"{shared}\n{prose(35, 5)}", "a b c d e a b c d e a b c d e", "é ü Ñ " * 20]
    out += [prose(60 + i, 100 + i) for i in range(70)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "a" if i % 3 else None, len(t or ""), 7) for i, t in enumerate(texts)]
    rows += [(0, texts[0], "en", None, 1, 7), (None, prose(50, 77), None, "b", 2, 7)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def classes_by_force(sets):
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def test_near_dedup_of_a_large_loose_group(spark, monkeypatch):
    """Similarities about the threshold, so that many components meet in the same buckets, cut into blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng, base, loose = random.Random(5), words(100, 9), []
    for i in range(160):
        w = list(base)
        for at in rng.sample(range(100), rng.randrange(2, 16)):
            w[at] = f"x{i}.{at}"
        loose.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 2]) for i in range(99)} for t in loose]
    frame = spark.createDataFrame(list(enumerate(loose)), "doc_id long, text string")
    got = by_id(near_dedup.near_duplicates(frame, words=2), "component_id")
    root = classes_by_force(sets)
    assert len(set(root)) > 5
    assert [got[i][0] for i in range(len(loose))] == root


def test_near_dedup(docs, texts, nothing):
    got = near_dedup.near_duplicates(docs, words=2)
    assert got.count() == docs.count()
    got = by_id(got, "n_shingles", "component_id", "kept")
    sets = []
    for t in texts:
        w = WORD.findall(low(t))
        sets.append({tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else set(map(tuple, [w] if w else [])))
    root = classes_by_force(sets)
    for i in range(len(texts)):
        assert got[i] == (len(sets[i]), root[i], root[i] == i)
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_near_dedup_takes_small_batches(spark, monkeypatch):
    """12 MB of text in one partition goes to Python in batches of about BATCH_BYTES, and the session is left as it was."""
    real, most = near_dedup.shingle_sets, 3 << 20

    def watched(column, n):
        assert column.nbytes < most, f"{column.nbytes} bytes at once"
        return real(column, n)

    monkeypatch.setattr(near_dedup, "shingle_sets", watched)
    frame = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 120), i -> sha2(concat(id div 2, ' ', i), 256))) AS text")
    frame = frame.selectExpr("doc_id", "substr(text, 1, 4000) AS text")
    got = by_id(near_dedup.near_duplicates(frame, words=2), "n_shingles", "component_id")
    assert got == {i: (61, i // 2 * 2) for i in range(3000)}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None


def test_line_dedup_cuts_large_batches_in_pieces():
    rows = [f"a{i}\n{'x' * 4000}\nb{i}" for i in range(3000)]
    spans = [[{"first": 1, "lines": 1}] if i % 2 else None for i in range(3000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(3000), "text": rows, "spans": spans})
    out = list(line_dedup.cut([batch, batch.slice(0, 0)]))
    assert max(x.nbytes for x in out) < 3 << 20
    whole = pa.Table.from_batches(out).to_pydict()
    assert whole["doc_id"] == list(range(3000)) and whole["n_removed"] == [i % 2 for i in range(3000)]
    assert whole["text"] == [f"a{i}\nb{i}" if i % 2 else rows[i] for i in range(3000)]


def test_line_dedup(docs, texts, nothing):
    got = by_id(line_dedup.line_dedup(docs), "text", "n_lines", "n_removed")
    lines = {i: [x.strip() for x in (t or "").split("\n") if x.strip()] for i, t in enumerate(texts)}
    seen, gone = {}, collections.defaultdict(set)
    for i, ls in lines.items():
        for a in range(len(ls)):
            for b in range(a + 1, min(len(ls), a + 60) + 1):
                run = tuple(ls[a:b])
                if sum(len(x.split()) for x in run) >= 50:
                    if run in seen:
                        gone[i].update(range(a, b))
                    seen.setdefault(run, i)
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] == (None, 0, 0)
            continue
        assert got[i][1:] == (len(lines[i]), len(gone[i]))
        left = [x.strip() for x in got[i][0].split("\n") if x.strip()]
        assert left == [x for k, x in enumerate(lines[i]) if k not in gone[i]]
    assert gone[1] and gone[9] and not gone[0]
    assert line_dedup.line_dedup(nothing).count() == 0


def removed_by_force(texts, least):
    """Lines of every run of `least` words that an earlier place holds."""
    lines = [[x.strip() for x in t.split("\n") if x.strip()] for t in texts]
    seen, gone = set(), [set() for _ in texts]
    for i, ls in enumerate(lines):
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                run = tuple(ls[a:b])
                if sum(len(x.split()) for x in run) >= least:
                    if run in seen:
                        gone[i].update(range(a, b))
                    seen.add(run)
    return lines, gone


def test_line_dedup_of_lines_in_many_contexts(spark, monkeypatch):
    """A small stock of lines, so that selected hashes meet in unrelated places and runs go on differently."""
    monkeypatch.setattr(common, "LEAST_SHARE", 16)
    rng = random.Random(21)
    stock = [" ".join(words(rng.randrange(1, 9), 500 + k)) for k in range(14)]
    texts = ["\n".join(rng.choice(stock) for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = by_id(line_dedup.line_dedup(frame, 12), "text", "n_lines", "n_removed")
    lines, gone = removed_by_force(texts, 12)
    assert [got[i][2] for i in range(150)] == [len(g) for g in gone]
    assert [got[i][0].split("\n") if len(gone[i]) < len(lines[i]) else [] for i in range(150)] == [[x for k, x in enumerate(ls) if k not in g] for ls, g in zip(lines, gone)]
    # without extension, lines behind the last window of a run stay
    monkeypatch.setattr(line_dedup, "agreeing", lambda *_: common.F.lit(0).cast("long"))
    less = by_id(line_dedup.line_dedup(frame.where("doc_id < 40"), 12), "n_removed")
    assert sum(x[0] for x in less.values()) <= sum(len(g) for g in removed_by_force(texts[:40], 12)[1])


def test_line_dedup_extends_along_the_occurrence_that_goes_on_alike(spark):
    a, b, c, d = (" ".join(words(20, 600 + k)) for k in range(4))
    texts = [f"{a}\n{b}\n{c}", f"{a}\n{b}\n{c}\nx y\n{d[:30]}", f"start\n{a}\n{b}\n{c}\nx y\nother", f"{a}\n{b}\n{c}\nx z"]
    got = by_id(line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "text")
    assert [got[i][0] for i in range(4)] == [texts[0], f"x y\n{d[:30]}", "start\nother", "x z"]


def test_decontaminate(spark, docs, texts, nothing):
    rng = random.Random(5)
    items = []
    for k in range(12):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(texts[rng.choice([0, 7, 8, 20, 30])]))
        a = rng.randrange(len(w))
        items.append((k, " ".join(w[a : a + rng.choice([3, 13, 20])])))
    items += [(50, None), (51, ""), (None, "w1 w2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.contamination(docs, bench), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        hit, ids = set(), set()
        for k, item in items:
            v = (item or "").split()
            n = min(13, len(v))
            if k is None or not n:
                continue
            grams = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)}
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in grams:
                    hit.update(range(a, a + n))
                    ids.add(str(k))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        assert got[i] == (len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w))
    assert any(v[4] for v in got.values())
    assert decontaminate.contamination(nothing, bench).count() == 0
    near = decontaminate.find_matches(docs, bench, slop=3)
    assert near.where("exact").count() and near.where("not exact").count()


def test_proximity_in_any_order(spark):
    rng = random.Random(11)
    texts = [[rng.choice("abcdefg") + "x" for _ in range(60)] for _ in range(12)]
    items = [[rng.choice("abcdefgh") + "x" for _ in range(n)] for n in (3, 4, 4, 5, 6)]
    size, slop, wanted = 4, 2, set()
    for i, w in enumerate(texts):
        for k, v in enumerate(items):
            n = min(size, len(v))
            for a in range(len(v) - n + 1):
                c = collections.Counter(v[a : a + n])
                holds = lambda x, y, w=w, c=c: all(w[x:y].count(z) >= m for z, m in c.items())
                wanted |= {(i, str(k), x, y) for x in range(len(w)) for y in range(x + n, min(len(w), x + n + slop) + 1) if holds(x, y) and not holds(x + 1, y) and not holds(x, y - 1)}
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in enumerate(items)], "item_id long, text string")
    got = decontaminate.find_matches(frame, bench, size, slop).where("not exact").collect()
    assert wanted and {(r["doc_id"], r["item_id"], r["start"], r["stop"]) for r in got} == wanted


def test_quality_rules(docs, texts, nothing):
    got = by_id(quality_rules.quality_rules(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {k + d for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for d in range(5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        assert got[i][:6] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep), failed)
        assert not (failed and got[i][6])
    assert quality_rules.quality_rules(nothing).count() == 0


def test_each_statistic_of_the_quality_rules_rejects(spark):
    rng = random.Random(3)

    def text(n, per_line=10, make=lambda w, k: w):
        w = [make("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 9))), k) for k in range(n)]
        return [" ".join(w[i : i + per_line]) for i in range(0, n, per_line)]

    rows = [text(rng.randrange(60, 200)) for _ in range(120)]
    passage = text(18)
    odd = {
        "words": text(8000),
        "word length": text(100, make=lambda w, k: w + w + w),
        "symbols": text(100, make=lambda w, k: "#" + w[1:] if k % 3 == 0 else w),
        "lines": [x for line in text(96, 8) for x in (line, "filler", "filler", "filler")],
        "repeated words": [*text(50), " ".join(passage), *text(50), " ".join(passage), *text(50)],
    }
    rows = ["\n".join(x) for x in [*rows, *odd.values()]]
    got = by_id(quality_rules.quality_rules(spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string")), "base_failed", "kept")
    assert {name: got[120 + i] for i, name in enumerate(odd)} == {name: (False, False) for name in odd}
    assert sum(got[i][1] for i in range(120)) >= 114


def test_minimum_covariance_determinant(spark):
    """Verdicts of one group against a search from many random starts in numpy, choosing by determinant."""
    rng = random.Random(12)
    rows = []
    for i in range(400):
        bad = i % 5 == 0
        n, size = int(rng.lognormvariate(4.6, 0.4)), 9 if bad else rng.choice([4, 5, 5, 6])
        w = ["".join(rng.choice("abcdefghijklmnop") for _ in range(max(1, size + rng.randrange(-2, 3)))) for _ in range(n)]
        w = ["#" + x[1:] if rng.random() < (0.3 if bad else 0.02) else x for x in w]
        rows.append((i, "\n".join(" ".join(w[k : k + 10]) for k in range(0, n, 10)), "en", "a"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    counts = quality_rules.base_counts(frame).select("doc_id", *quality_rules.transformed()).orderBy("doc_id").toPandas()
    x = counts[[f"x{i}" for i in range(6)]].to_numpy() / 4096
    p, h = 5, 300

    def estimate(rows_, scale):
        mean = rows_.mean(0)
        logs = [mean[0], mean[0], mean[0] + mean[1], mean[5], max(0, mean[0] - np.log(5))]
        cov = np.cov(rows_[:, :p].T, bias=True) * scale
        floor = np.array(quality_rules.LEAST_VARIANCE) * np.exp(-np.array(logs))
        np.fill_diagonal(cov, np.maximum(np.diag(cov), floor) * (1 + quality_rules.RIDGE))
        return mean[:p], cov

    best = None
    draw = np.random.default_rng(6)
    for _ in range(100):
        mean, cov = estimate(x[draw.choice(len(x), 12, replace=False)], 1)
        for _ in range(40):
            d2 = np.einsum("ij,jk,ik->i", x[:, :p] - mean, np.linalg.inv(cov), x[:, :p] - mean)
            mean, cov = estimate(x[np.argsort(d2, kind="stable")[:h]], quality_rules.consistency(0.75, p))
        if best is None or np.linalg.slogdet(cov)[1] < best[0]:
            best = np.linalg.slogdet(cov)[1], d2
    wanted = best[1] <= quality_rules.chi_square_quantile(quality_rules.QUANTILE, p)
    got = by_id(quality_rules.quality_rules(frame), "kept")
    kept = np.array([got[i][0] for i in range(400)])
    assert (kept == wanted).mean() >= 0.98
    # without robust starts and concentration, a fifth of outliers hides itself
    mean, cov = estimate(x, 1)
    plain = np.einsum("ij,jk,ik->i", x[:, :p] - mean, np.linalg.inv(cov), x[:, :p] - mean) <= quality_rules.chi_square_quantile(quality_rules.QUANTILE, p)
    bad = np.arange(400) % 5 == 0
    assert (~kept[bad]).mean() > 0.9 and kept[~bad].mean() > 0.97 and (~plain[bad]).mean() < 0.5


def test_chi_square():
    assert quality_rules.chi_square_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


def test_mixing(docs, texts, nothing):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == docs.count()
    taken, target = collections.Counter(), {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["target"]] += r["taken"]
    for t, n in taken.items():
        assert abs(n - t) <= 100
    again = sorted((r["doc_id"] or -1, r["taken"]) for r in mixing.mixed(docs.repartition(5)).collect())
    assert again == sorted((r["doc_id"] or -1, r["taken"]) for r in rows)
    assert mixing.mixed(nothing).count() == 0


def shares(sizes, weights=(5, 2, 1), total=1.5, cap=2):
    """Targets by filling up: whoever is full stops, and the rest is dealt again."""
    names = sorted(sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        level = (total * sum(sizes.values()) - sum(cap * sizes[s] for s in full)) / sum(w[s] for s in names if s not in full)
        more = {s for s in names if s not in full and w[s] * level > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in full else w[s] * level for s in names}
        full |= more


def test_mixing_solves_the_dual(spark):
    """Rates of documents against a dense Newton solve in numpy; without the tilt the targets are missed."""
    rng = random.Random(8)
    rows = []
    for i in range(900):
        source = rng.choice("aaaabbcdddddd")
        rows.append((i, " ".join(["w"] * int(rng.lognormvariate(4 if source in "ab" else 5, 1.2) + 1)), source))
    got = {r["doc_id"]: r for r in mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    n = np.array([len(t.split()) for _, t, _ in rows], float)
    names = sorted({s for *_, s in rows})
    src = np.array([names.index(s) for *_, s in rows])
    sizes = {s: float(n[src == k].sum()) for k, s in enumerate(names)}
    wanted = shares(sizes)
    goal = np.array([wanted[s] for s in names])
    assert all(got[i]["target"] == pytest.approx(goal[src[i]]) for i in got)
    free = goal < 2 * np.array([sizes[s] for s in names]) - 1e-6
    assert free.any() and not free.all()
    band = np.minimum((np.log2(n) / 3 + 1e-9).astype(int), mixing.BANDS - 1)
    u, k = 1 + np.log(n), len(names) + mixing.BANDS
    x = np.zeros((len(n), k))
    x[np.arange(len(n)), src] = x[np.arange(len(n)), len(names) + band] = 1
    share = np.array([n[band == b].sum() for b in range(mixing.BANDS)]) / n.sum() * goal.sum()
    soft = np.concatenate([np.zeros(len(names)), mixing.SOFT * np.maximum(share, 1)])
    ask, at, on = np.concatenate([goal, share]), np.zeros(k), np.concatenate([free, np.ones(mixing.BANDS, bool)])
    pinned = ~free[src]
    for _ in range(400):
        r = np.where(pinned, 2, np.minimum(2, np.exp(u * (x @ at))))
        slope = x.T @ (n * r) - ask + soft * at
        curve = (x * (n * u * r * (~pinned & (r < 2)))[:, None]).T @ x + np.diag(soft + 1e-6)
        at[on] -= 0.5 * np.linalg.solve(curve[np.ix_(on, on)], slope[on])
    assert max(abs(got[i]["rate"] - r[i]) for i in range(len(rows))) < 1e-6
    # rates differ within a source, and a rate of 1 for all, without the method, misses the targets
    assert max(np.ptp(r[src == k]) for k in np.flatnonzero(free)) > 0.05
    taken = np.array([sum(got[i]["taken"] for i in np.flatnonzero(src == k)) for k in range(len(names))])
    assert np.abs(taken - goal).max() <= n.max() / 2
    assert np.abs(np.array([sizes[s] for s in names]) - goal).max() > 5 * n.max()


def test_language_model(docs, texts, nothing):
    import math

    trainable = lambda c: c % 2 == 0
    tokens = {i: [*WORD.findall(low(t)), "\0"] for i, t in enumerate(texts)}
    count = collections.Counter()
    for i, t in enumerate([*texts, texts[0]]):
        if i % 2 == 0 or i == len(texts):
            count.update(WORD.findall(low(t)) + ["\0"])
    n, v = sum(count.values()), len(count)
    for top in (1 << 20, 50):
        got = by_id(language_model.language_model(docs, trainable, top), "n_tokens", "n_known", "train_tokens", "base_score", "score")
        for i, t in tokens.items():
            base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)
            assert got[i][:3] == (len(t), sum(count[w] > 0 for w in t), n)
            assert got[i][3] == pytest.approx(base, rel=1e-9)
            assert got[i][4] < 0
    assert language_model.language_model(nothing, trainable).count() == 0


def test_the_language_model_learns_from_context(spark, monkeypatch):
    """Texts in two vocabularies: what stands before tells which; without weights the model knows shares only."""
    rng = random.Random(2)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{int(rng.paretovariate(0.7))}" for _ in range(60))) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    trainable = lambda c: c % 5 != 0

    def held_out():
        got = language_model.language_model(frame, trainable).where("doc_id % 5 = 0").collect()
        return sum(r["score"] for r in got) / sum(r["n_tokens"] for r in got)

    with_weights = held_out()
    monkeypatch.setattr(language_model, "RATE", 0.0)
    assert with_weights > held_out() + 0.15


def test_no_word_is_lost_beyond_the_dictionary(spark, monkeypatch):
    """With any size of dictionary the probabilities of the end, of every word seen and of the unseen sum to 1."""
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6)) % 4000}" for _ in range(6000)]
    count = collections.Counter(words)
    rows = [(2 * i, " ".join(words[60 * i : 60 * i + 60])) for i in range(100)]
    known = sorted(count)
    rows += [(2 * i + 1, w) for i, w in enumerate(["", "unseen", *known])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(language_model, "RATE", 0.0)
    for top in (1 << 20, 50, 0):
        got = {r["doc_id"]: r["score"] for r in language_model.language_model(frame, lambda c: c % 2 == 0, top).collect()}
        p = {w: 10 ** (got[2 * i + 1] - got[1]) for i, w in enumerate(["", "unseen", *known])}
        # half a token goes to each empty slot
        assert 10 ** got[1] + p["unseen"] + sum(p[w] for w in known) == pytest.approx(1, abs=0.01)
        # what is outside has the share of its own count
        rare = [w for w, n in count.items() if n == 1 or top == 0]
        assert len(rare) > 200 and max(p[w] / count[w] for w in rare) == pytest.approx(min(p[w] / count[w] for w in rare), rel=1e-3 if top < 100 else 1)


def test_softmax_steps_against_the_gradient():
    """One step on a fresh table moves against the gradient of the loss, found by differences."""
    rng = np.random.default_rng(0)
    rows, wanted, bias = rng.integers(0, 6, (3, 8)), rng.integers(0, 4, 8), rng.normal(size=4)
    table = language_model.Steps(np.zeros((6, 4)))
    table.step(rows, wanted, bias)

    def loss(w):
        z = w[rows].sum(0) + bias
        return (np.log(np.exp(z).sum(1)) - z[np.arange(8), wanted]).sum()

    slope = np.zeros((6, 4))
    for i in range(6):
        for j in range(4):
            up = np.zeros((6, 4))
            up[i, j] = 1e-5
            slope[i, j] = (loss(up) - loss(-up)) / 2e-5
    g = slope / np.sqrt(np.maximum(1, np.bincount(rows.ravel(), minlength=6)))[:, None]
    expected = -language_model.RATE * g / np.sqrt(language_model.CALM + (g * g).mean(1, keepdims=True))
    assert np.allclose(table.w, expected, atol=1e-6)


def test_html():
    page = """<html><head><title>x</title></head><body><header>Site</header><nav><a>m</a></nav><div id="cookie-notice">We</div>
    <article><h1>T &amp; t</h1><p>Para  one &eacute;<p>Two <b>bold</b><script>var t="</p>";</script><form>f</form><div class="ad">buy</div>
    <ul><li>a<li>b</ul><section class="comments"><p>nice</p></section></article><footer>f</footer>"""
    assert [t for _, t in html_extract.page_blocks(page, None)] == ["T & t", "Para one é", "Two bold", "a", "b"]


def test_template_slots_go_and_copies_stay(spark):
    page = "<body><div class=top><p>Same</p></div><div class=x><p>{}</p></div></body>"
    rows = [(i, f"http://a.example/{i}", page.format(f"Text {i}")) for i in range(8)] + [(20, None, None), (21, "http://b.example/", "")]
    rows += [(30 + i, f"http://c.example/{i}", page.format("copy")) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Text 3" and got[20] == got[21] == "" and got[31] == "Same\ncopy"


def test_class_words_mark_but_do_not_cut(spark):
    pages = [
        "<div id='page' class='has-sidebar'><article><header class='entry-header'><h1>Title</h1></header><p>Text</p></article></div>",
        "<div class='post-content with-sidebar'><p>Text</p><div class='ad'>buy</div></div>",
        "<div class='sidebar'><article><p>Text</p></article></div>",
        "<form id=f><article class='post'><p>One</p></article><article><p>Longer two</p></article></form><div class='related'><article><p>Other</p></article></div>",
        "<div class='sidebar'><article><p>Teaser</p></article></div><article><p>Text</p></article>",
    ]
    got = [[t for _, t in html_extract.page_blocks(p, None)] for p in pages]
    assert got == [["Title", "Text"], ["Text"], ["Text"], ["One", "Longer two"], ["Text"]]
    # a marked slot inside the article: its varying text stays, its constant text goes
    page = "<article><p>Text {0}</p><div class=notice><p>Note {0}</p></div><div class=widget><p>Same</p></div><div class=comments><p>Nice {0}</p></div></article><div class=sidebar><p>Side {0}</p></div>"
    rows = [(i, f"http://a.example/{i}", page.format(i)) for i in range(8)] + [(20, "http://b.example/", page.format(20))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Text 3\nNote 3" and got[20] == "Text 20"


def test_html_that_is_never_closed():
    """Depth, open tags and quotes cost time in proportion to the page, and lose no text."""
    import time

    deep = "".join(f"<div>t{i} " for i in range(3000)) + "</div>" * 3000 + "<p>end</p>"
    start = time.time()
    text = " ".join(t for _, t in html_extract.page_blocks(deep, None))
    assert text.split() == [*(f"t{i}" for i in range(3000)), "end"]
    for page in ("<a " * 20000, "<a href='" * 20000, "<p " + "<a \"'" * 20000, "<b>" * 20000 + "x</i>" * 20000, "<!" * 20000, "<div><p>a</div>" * 5000):
        html_extract.page_blocks(page, html_extract.skeleton(html_extract.parse("<div><p>a</div>")))
    assert time.time() - start < 20
    assert [t for _, t in html_extract.page_blocks("<p title='a > b'>x</p><p title='y>z</p>1 < 2 <3", None)] == ["x", "z", "1 < 2 <3"]


def test_tree_matching_against_all_alignments():
    """The greatest number of matched nodes, over all ordered pairings of children."""
    rng = random.Random(9)

    def tree(depth):
        return [rng.choice(["div", "ul"]), [tree(depth - 1) for _ in range(rng.randrange(4))] if depth else []]

    def node(t):
        out = html_extract.Node(t[0])
        out.children = [node(c) for c in t[1]]
        return out

    def best(a, b):
        if not a or not b:
            return 0
        together = 1 + best(a[0][1], b[0][1]) + best(a[1:], b[1:]) if a[0][0] == b[0][0] else 0
        return max(together, best(a[1:], b), best(a, b[1:]))

    for _ in range(60):
        a, b = tree(3), tree(3)
        b[0] = a[0]
        assert html_extract.match(node(a), b) == best([a], [b])
    # a chain of lists that differ at every level: each pair is matched once
    left, right = ["div", []], ["div", []]
    for _ in range(60):
        left, right = ["div", [["ul", []], left, ["ul", []]]], ["div", [["div", []], right, ["div", []]]]
    assert html_extract.match(node(left), right) == 61


def test_tree_matching_of_very_many_children():
    """The greatest number of matched nodes does not depend on how many children there are."""

    def tree(kids):
        return ["div", [[k, []] for k in kids]]

    def node(t):
        out = html_extract.Node(t[0])
        out.children = [node(c) for c in t[1]]
        return out

    # of the page's 600 lists and the paragraphs before and after, the reference has the lists only at its end
    left = tree(["h1", "p", *["ul"] * 600, "h2"])
    right = tree(["h2", *["ol"] * 300, "p", *["ol"] * 300, *["ul"] * 600, "h3"])
    assert html_extract.match(node(left), right) == 602
    # where the next free child with the label is not the best one: both the lists and the table match
    left, right = tree(["p", "table", *["ul"] * 600, "p"]), tree([*["ul"] * 600, "table", "p", "h1"])
    assert html_extract.match(node(left), right) == 602


def test_wrappers_without_telling_names(spark):
    """Same-host pages without any telling tag or class: alignment alone separates template from text."""
    page = "<div><div>Home | About | Contact</div>{2}<div><div>{0}</div><div>Posted in News</div><div>{1}</div></div><div>All rights reserved</div></div>"
    rows = [(i, f"http://a.example/{i}", page.format(f"Title {i}", f"Body of text {i}", "<div>Breaking: x</div>" if i % 3 == 0 else "")) for i in range(12)]
    rows += [(100 + i, f"http://few.example/{i}", page.format(f"Few {i}", f"Small {i}", "")) for i in range(2)]
    rows += [(200 + i, f"http://near.example/{i}", f"<div>Menu</div><article><p>Same paragraph</p><p>Own {i}</p></article>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in (1, 2)] == ["Title 1\nBody of text 1", "Title 2\nBody of text 2"]
    assert got[100] == "Few 0\nSmall 0" and got[201] == "Same paragraph\nOwn 1"
    # the same pages without other pages of their host keep the template
    alone = [t for _, t in html_extract.page_blocks(rows[1][2], None)]
    assert "Home | About | Contact" in alone and "All rights reserved" in alone
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_license_scan(spark, nothing):
    mit = license_scan.TEMPLATES["mit"]
    cut = " ".join(mit.split()[8:])
    rows = [(1, f"{prose(200, 8)}\n{mit}\n{prose(50, 9)}"), (2, cut), (3, " ".join(mit.split()[:20])), (4, None), (5, "Released under the MIT License.")]
    got = {(r["doc_id"], r["template"]) for r in license_scan.license_matches(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.TEMPLATES).collect()}
    assert got == {(1, "mit"), (2, "mit"), (5, "mit-notice")}
    assert license_scan.license_matches(nothing, license_scan.TEMPLATES).count() == 0


def test_license_scan_against_all_windows(spark):
    """Every window of the grid against every template of its class: nothing that holds 80 % is missed."""
    rng = random.Random(31)
    templates = license_scan.TEMPLATES
    word = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    texts = []
    for i in range(120):
        w = word(rng.choice(list(templates.values())))
        for _ in range(rng.randrange(0, 1 + len(w) // 15)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        texts.append(" ".join([*words(rng.randrange(150), i), *w[rng.randrange(3) :], *words(rng.randrange(90), 900 + i)]))
    texts += [texts[0], "", None, " ".join(words(400, 5))]
    own = {t: set(grams(word(x))) for t, x in templates.items()}
    wanted = {}
    for shortest, longest in license_scan.classes([len(v) for v in own.values()]):
        width, stride = license_scan.window_of(longest), license_scan.stride_of(longest)
        for i, t in enumerate(texts):
            g = grams(word(t or ""))
            for name, shingles in own.items():
                if shortest <= len(shingles) <= longest:
                    found = [(len(shingles & set(g[a : a + width])), -a) for a in range(0, max(1, len(g)), stride)]
                    held = [(n, a) for n, a in found if n >= 0.8 * len(shingles)]
                    if held:
                        wanted[i, name] = (len(shingles), max(n for n, _ in held), min(-a for _, a in held))
    got = license_scan.license_matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates).collect()
    assert len(wanted) > 60 and {(r["doc_id"], r["template"]): (r["n_shingles"], r["n_matched"], r["first_window"]) for r in got} == wanted


def test_learned_scores(spark, nothing):
    rows = [(i, prose(40, i) + (" vile" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(240)] + [(900, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int")
    labels = docs.where("text is not null").selectExpr("doc_id", "mark toxic", "1 - mark quality")
    got = by_id(toxicity.toxicity(docs, labels), "held_out", "predicted", "score")
    held = [(p, rows[i][2]) for i, (h, p, _) in got.items() if h and i < 900]
    assert sum(p == m for p, m in held) >= 0.95 * len(held)
    assert all(0 <= s <= 1 for _, _, s in got.values()) and len(got) == 241
    scores = by_id(quality_model.quality(docs, labels), "score")
    assert len(scores) == 241 and all(0 <= s[0] <= 1 for s in scores.values())
    assert toxicity.toxicity(nothing, labels.limit(0)).count() == 0
    assert quality_model.quality(nothing, labels.limit(0)).count() == 0


def test_learned_scores_of_few_labels(spark):
    docs = spark.createDataFrame([(i, prose(30, i)) for i in range(30)] + [(None, "x y")], "doc_id long, text string")
    made = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int, quality int")
    some = {"none": [], "one": [(2, 1, 1)], "null": [(None, 1, 1), (3, None, None)], "all toxic": [(i, 1, 1) for i in range(30)], "none here": [(500 + i, 1, 0) for i in range(9)], "clean": [(i, 0, 0) for i in range(30)]}
    for name, rows in some.items():
        for got in (toxicity.toxicity(docs, made(rows)).collect(), quality_model.quality(docs, made(rows)).collect()):
            assert len(got) == 31 and all(0 <= r["score"] <= 1 for r in got), name
    rows = some["all toxic"]
    usable = [i for i in range(30) if zlib.crc32(str(i).encode()) % 5]
    got = by_id(quality_model.quality(docs, made(rows)), "held_out", "score", "predicted")
    assert all(got[i] == (i not in usable, pytest.approx((len(usable) + 1) / (len(usable) + 2)), 1) for i in range(30))
    assert {r["predicted"] for r in toxicity.toxicity(docs, made(some["none here"])).collect()} == {0}


def test_the_risk_is_corrected_by_the_class_prior():
    """Unlabelled texts of which a third are positive: the corrected risk finds them, positive against unlabelled doesn't."""
    rng = np.random.default_rng(1)
    mark = np.concatenate([np.ones(200, bool), np.zeros(600, bool)])
    truth = np.concatenate([np.ones(400, bool), np.zeros(400, bool)])
    rows = [np.flatnonzero(rng.random(20) < np.where(np.arange(20) < 6, 0.7 if t else 0.05, 0.3)) for t in truth]

    def scores(w, b):
        return toxicity.sigmoid(np.array([w[r].sum() for r in rows]) + b)

    p = scores(*toxicity.fit(rows, mark, 1 / 3, 20))
    assert ((p >= 0.5) == truth)[200:].mean() > 0.92
    flat, of = np.concatenate(rows), np.repeat(np.arange(800), [len(r) for r in rows])
    w, b = np.zeros(20), 0.0
    for _ in range(2000):
        off = toxicity.sigmoid(b + np.bincount(of, w[flat], minlength=800)) - mark
        w, b = w - 2 * np.bincount(flat, off[of], minlength=20) / 800, b - 2 * off.mean()
    assert ((scores(w, b) >= 0.5) == truth)[200:].mean() < 0.85


def test_held_out_quality_and_calibration(spark):
    """Labels by vocabulary: held-out accuracy, and probabilities that agree with the labels' noise."""
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(600):
        good = i % 2
        rows.append((i, " ".join(f"{'fine' if good else 'poor'}{rng.randrange(40)}" if rng.random() < 0.5 else f"w{rng.randrange(200)}" for _ in range(40))))
        marks.append((i, good if rng.random() < 0.9 else 1 - good))
    got = by_id(quality_model.quality(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")), "held_out", "score")
    held = [(s, i % 2) for i, (h, s) in got.items() if h]
    assert sum((s >= 0.5) == bool(y) for s, y in held) >= 0.95 * len(held)
    # 10 % of the labels are wrong, so calibrated probabilities stay well off 0 and 1
    assert 0.75 < np.mean([s if y else 1 - s for s, y in held]) < 0.96
