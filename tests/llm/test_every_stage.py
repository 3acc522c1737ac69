"""Every stage with columns of clashing names, null ids, repeated rows, very long texts and an empty table."""

import random

import pytest

import corpus_pipeline
from nightloom.llm import common

#: Names that operators use for columns of their own.
NAMES = ("row", "row_", "doc_id_", "doc", "rest", "spans", "n_lines", "n_removed", "kept", "copies", "target", "source_size", "src", "size", "rate", "g", "words", "hits", "bucket", "node", "salt", "row_of_text", "rank", "`quoted`")


def line(n, seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(9000)}" for _ in range(n))


def table():
    lines = [line(12, 1000 + k) for k in range(20_000)]
    long = "\n".join(lines)
    assert len(long) > common.PIECE_BYTES
    texts = [(0, long), (1, "\n".join([line(20, 1), *lines[50:60], line(20, 2)])), (2, line(80, 3)), (2, line(80, 3)), (2, line(80, 4)), (None, line(80, 5)), (None, line(80, 5)), (3, None), (4, ""), (5, line(70, 6))]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES)
    return [(i, t, "en", None if k % 4 == 0 else "ab"[k % 2], len(t or ""), *(f"{n}{i}" for n in NAMES)) for k, (i, t) in enumerate(texts)], schema


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stages"))
    spark.createDataFrame([(1, line(40, 77)), (None, "a b"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_clashing_columns(spark, folder, name, stage):
    rows, schema = table()
    docs = spark.createDataFrame(rows, schema).repartition(2)
    got = stage(spark, docs, folder)
    assert got.columns[: len(docs.columns)] == docs.columns
    out = got.collect()
    assert out
    known = {(r[0], r[1]) for r in rows}
    for r in out:
        # every column still belongs to its document
        assert all(r[5 + k] == f"{n}{r[0]}" for k, n in enumerate(NAMES))
        assert (r[0], r[1]) in known or name == "line_dedup"
    ids = sorted((-1 if r[0] is None else r[0]) for r in out)
    if name == "quality_rules":
        assert ids == [-1, -1, 0, 1, 2, 2, 2, 5]
    if name == "line_dedup":
        texts = {r[0]: r[1] for r in out}
        assert texts[1] == f"{line(20, 1)}\n{line(20, 2)}" and texts[0] == rows[0][1] and texts[3] is None
    if name == "near_dedup":
        assert ids == [-1, 0, 1, 2, 2, 3, 4, 5]
    if name == "decontaminate":
        assert ids == [-1, -1, 0, 1, 2, 2, 2, 3, 4, 5]
    if name == "mix_sources":
        assert got.columns[len(docs.columns) :] == ["copies_", "source_size_", "target_"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_nothing(spark, folder, name, stage):
    _, schema = table()
    got = stage(spark, spark.createDataFrame([], schema), folder)
    assert got.count() == 0 and "row_of_text" in got.columns
