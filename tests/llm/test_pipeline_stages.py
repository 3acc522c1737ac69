"""The pipeline and each of its stages against brute force: nulls, repeated rows, an empty table, an extra column."""

import collections
import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def line(n, seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


ITEM, SHARED, LONG = line(20, 1), line(60, 2), line(200, 3)


def row(i, text, source="a"):
    return (i, text, "en", source, len(text or ""), 7 if i is None else 10 + i)


def table():
    near = LONG.split()
    near[100] = "changed"
    rows = [row(0, LONG), row(0, LONG), row(1, " ".join(near), "b"), row(2, None), row(3, "too short"), row(4, ""), row(None, line(90, 4), None)]
    rows += [row(5, f"{line(30, 5)}\n{SHARED}\n{line(30, 6)}"), row(6, f"{line(40, 7)}\n{SHARED}", "b"), row(7, SHARED), row(8, f"{line(10, 8)} {ITEM} {line(10, 9)}"), row(9, " ".join([line(8, 10)] * 5))]
    return rows + [row(10 + i, line(60 + 5 * i, 100 + i), "ab"[i % 2]) for i in range(12)]


def good(rows):
    out = []
    for r in rows:
        w = (r[1] or "").split()
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {k + d for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for d in range(5)}
        if len(w) >= 10 and 5 * len(again) <= len(w):
            out.append(r)
    return out


def unrepeated(rows):
    """Every line of 50 words or more that an earlier document has goes; in this table no other run is repeated."""
    first, out = {}, []
    for r in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        lines = r[1].split("\n")
        left = [x for x in lines if len(x.split()) < 50 or first.setdefault(x, r[0]) == r[0]]
        if left:
            text = "\n".join(left)
            out.append((*r[:1], text, *r[2:4], r[4] if left == lines else len(text), r[5]))
    return out


def distinct(rows):
    sets = {r[0]: {tuple(r[1].split()[k : k + 5]) for k in range(len(r[1].split()) - 4)} for r in rows if r[0] is not None}
    gone = {i for i, s in sets.items() if any(j < i and 5 * len(s & t) >= 4 * len(s | t) for j, t in sets.items())}
    return [r for r in rows if r[0] is None] + list({r[0]: r for r in rows if r[0] is not None and r[0] not in gone}.values())


def clean(rows):
    grams = {tuple(ITEM.split()[k : k + 13]) for k in range(8)}
    out = []
    for r in rows:
        w = r[1].split()
        hit = {k + d for k in range(len(w) - 12) if tuple(w[k : k + 13]) in grams for d in range(13)}
        if not hit or 20 * len(hit) < len(w):
            out.append(r)
    return out


FORCE = {"quality_rules": good, "line_dedup": unrepeated, "near_dedup": distinct, "decontaminate": clean}


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(table(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("x", ITEM), ("y", None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_and_run(spark, folder):
    rows, sizes = table(), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, spark.createDataFrame(rows, SCHEMA), folder)
        assert got.columns == [x.split()[0] for x in SCHEMA.split(", ")]
        rows = FORCE[name](rows)
        assert ordered(got.collect()) == ordered(rows), name
        sizes.append(len(rows))
    # every stage dropped something: 4 texts fail, 7 is all repeated, 0 comes twice and 1 is near it, 8 is contaminated
    assert sizes == [20, 19, 17, 16]
    whole = corpus_pipeline.run(spark, folder).collect()
    parts = {tuple(r)[:6]: r for r in whole}
    assert len(parts) == len(whole) and set(parts) <= set(rows)
    taken, wanted, size = collections.Counter(), {}, collections.Counter()
    for r in rows:
        size[r[3]] += len(r[1].split())
    for r in whole:
        assert r["copies"] in (1, 2) and r["source_size"] == size[r["source"]]
        taken[r["source"]] += r["copies"] * len(r["text"].split())
        wanted[r["source"]] = r["target"]
    # a source is met to within one of its texts
    assert set(taken) == set(size) and all(abs(taken[s] - wanted[s]) <= 200 for s in size)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_nothing(spark, folder, name, stage):
    got = stage(spark, spark.createDataFrame([], SCHEMA), folder)
    assert got.count() == 0 and got.columns[:6] == [x.split()[0] for x in SCHEMA.split(", ")]


def block_bytes(spark):
    """In how large blocks Spark lays out a broadcast just now."""
    sent = spark.sparkContext._jsc.broadcast("x")
    size = next(f for f in sent.getClass().getDeclaredFields() if f.getName() == "blockSize")
    size.setAccessible(True)
    return size.get(sent)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_broadcasts_are_small(spark, folder, name, stage):
    """Under 512 KB, half a region of a small driver's heap; a size that the application sets stays."""
    conf, key = spark.sparkContext._jsc.sc().conf(), "spark.broadcast.blockSize"
    nothing = spark.createDataFrame([], SCHEMA)
    conf.remove(key)
    try:
        stage(spark, nothing, folder)
        assert block_bytes(spark) < 512 << 10
        conf.set(key, "1m")
        stage(spark, nothing, folder)
        assert block_bytes(spark) == 1 << 20
    finally:
        conf.remove(key)
