"""Benchmark decontamination with a distributed positional inverted index.

1. Items become word sequences; a window is ``size`` consecutive words of an item, or the whole
   item if it has fewer (but any).
2. One pass counts, over all training texts, the words that items use. A window with a word that no
   text has cannot occur and is dropped.
3. Each window is entered by its two rarest words. Windows of an item that share both share the
   entry, so an item has a few entries only.
4. A second pass stores postings (word, text, position) of the entry words: the inverted index.
5. The rarest word's postings, moved by the word's offset, give alignments of item and text; they
   are intersected with the moved postings of the second word (with ``slop``, anywhere in the stretch).
6. Each surviving alignment is compared word by word along its diagonal, which gives the exact
   phrase matches; with ``slop`` also the proximity matches: places where all words of a window
   stand, each as often as there, within ``size + slop`` words in any order (the least such stretches).

A fixed-size bitmap of 2^22 bits (512 KB, whatever the input) keeps other words out of steps 2 and
4; its false positives are removed by the joins. Nothing else is broadcast by hand or gathered.

Defined results: null text or item has no words. Texts are told apart by (doc_id, hash of the
text), so repeated doc_ids and null ones keep results of their own. Items with a null id have no
windows. Equal item ids are one item with the windows of each row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, documents, same_row, table, text_key, tokens, whole_rows

SIZE = 13
FILTER_BITS = 22


def item_words(items: DataFrame) -> DataFrame:
    """item_id (text), part (tells repeated ids apart), words (array of hashes)."""

    def run(batches):
        for batch in batches:
            rows = []
            for _, bounds, h, *_ in tokens(batch.column(1), "alnum"):
                rows.extend(h[a:b].view(np.int64) for a, b in zip(bounds[:-1], bounds[1:]))
            offs = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], ["item_id", "part", "words"])

    source = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    source = source.withColumn("part", F.xxhash64("text"))
    return source.mapInArrow(run, "item_id string, part long, words array<long>").where("size(words) > 0")


def bitmap(words: DataFrame) -> np.ndarray:
    """Which of 2^22 slots the words fall into: at most 2^22 numbers reach the driver."""
    slots = words.select(F.shiftrightunsigned("word", 64 - FILTER_BITS).cast("int").alias("slot")).distinct().toPandas()["slot"]
    flags = np.zeros(1 << FILTER_BITS, bool)
    flags[slots.to_numpy(np.int64)] = True
    return np.packbits(flags)


def in_filter(flags: np.ndarray, h: np.ndarray) -> np.ndarray:
    return flags[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(text_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame, packed) -> DataFrame:
    """word, n over all texts, of the words that pass the filter."""

    def run(batches):
        flags = np.unpackbits(packed.value).astype(bool)
        for batch in batches:
            for _, _, h, *_ in tokens(batch.column(0), "alnum"):
                word, n = np.unique(h[in_filter(flags, h)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, packed) -> DataFrame:
    """row, doc_id, word, pos of the words that pass the filter."""

    def run(batches):
        flags = np.unpackbits(packed.value).astype(bool)
        for batch in batches:
            row, doc = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for first, bounds, h, *_ in tokens(batch.column(2), "alnum"):
                at = np.flatnonzero(in_filter(flags, h))
                of = np.searchsorted(bounds, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[first + of]), doc.take(pa.array(first + of)), pa.array(h[at].view(np.int64)), pa.array((at - bounds[of]).astype(np.int64))],
                    ["row", "doc_id", "word", "pos"],
                )

    return keyed(docs).mapInArrow(run, "row long, doc_id long, word long, pos long")


def doc_lengths(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            n = np.concatenate([np.zeros(0, np.int64), *(np.diff(t[1]) for t in tokens(batch.column(2), "alnum"))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int64))], ["row", "doc_id", "n_words"])

    return keyed(docs).mapInArrow(run, "row long, doc_id long, n_words long")


def aligned(size: int, slop: int):
    """For mapInArrow over (row, doc_id, text, found): spans of exact and of near matches."""

    def run(batches):
        for batch in batches:
            out = {"row": [], "doc_id": [], "item_id": [], "start": [], "stop": [], "exact": []}
            row, doc, found = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            for first, bounds, h, *_ in tokens(batch.column(2), "alnum"):
                for i in range(len(bounds) - 1):
                    text = h[bounds[i] : bounds[i + 1]]
                    for f in found[first + i].as_py():
                        item = np.array(f["words"], np.int64).view(np.uint64)
                        for exact, a, b in matches(text, item, f["diagonal"], size, slop):
                            for k, v in zip(out, (row[first + i], doc[first + i], f["item_id"], a, b, exact)):
                                out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("exact", pa.bool_())]))

    return run


def matches(text: np.ndarray, item: np.ndarray, diagonal: int, size: int, slop: int):
    """(exact, start, stop) in the text, along item position + diagonal = text position."""
    need = min(size, len(item))
    lo, hi = max(0, -diagonal), min(len(item), len(text) - diagonal)
    if hi - lo >= need:
        same = np.concatenate([[False], item[lo:hi] == text[lo + diagonal : hi + diagonal], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a >= need:
                yield True, int(lo + diagonal + a), int(lo + diagonal + b)
    if slop:
        reach = need + slop - 1
        for a in range(len(item) - need + 1):
            # the rarest word stands at one of the window's places on this diagonal; the others within reach of it
            lo = max(0, a + diagonal - reach)
            for x, y in covering(text[lo : max(lo, a + diagonal + need + reach)], item[a : a + need], need + slop):
                yield False, lo + x, lo + y


def covering(span: np.ndarray, words: np.ndarray, longest: int):
    """(start, stop) of the least stretches that hold the words, each as often as given, within `longest`."""
    kinds, wanted = np.unique(words, return_counts=True)
    place = np.flatnonzero(np.isin(span, kinds))
    kind = np.searchsorted(kinds, span[place])
    missing, short, first = wanted.copy(), len(kinds), 0
    for last, k in enumerate(kind):
        missing[k] -= 1
        short -= missing[k] == 0
        if short:
            continue
        while missing[kind[first]] < 0:
            missing[kind[first]] += 1
            first += 1
        start, stop = int(place[first]), int(place[last]) + 1
        if stop - start <= longest:
            yield start, stop
        # without its first word the stretch falls short, and the next one begins after it
        missing[kind[first]] += 1
        short += 1
        first += 1


def find_matches(docs: DataFrame, items: DataFrame, size: int = SIZE, slop: int = 0) -> DataFrame:
    """row, doc_id, item_id, start, stop, exact: maximal spans of words that items share with texts."""
    spark: SparkSession = docs.sparkSession
    work = Workspace(spark, "index")
    sc = spark.sparkContext
    own = work.keep(item_words(items), "items")
    used = own.select(F.explode("words").alias("word")).distinct()
    counts = word_counts(docs, sc.broadcast(bitmap(used)))
    # windows: start a of the item; need = words of each
    need = F.least(F.lit(size), F.size("words"))
    windows = own.select("item_id", "part", "words", need.alias("need"), F.explode(F.sequence(F.lit(0), F.size("words") - need)).alias("a"))
    parts = windows.select("item_id", "part", "need", "a", F.explode(F.sequence(F.col("a"), F.col("a") + F.col("need") - 1)).alias("at"), "words").select("item_id", "part", "need", "a", "at", F.element_at("words", F.col("at") + 1).alias("word"))
    rated = parts.join(counts, "word")
    window = Window.partitionBy("item_id", "part", "a").orderBy("n", "at")
    size_of = Window.partitionBy("item_id", "part", "a")
    ranked = rated.select("*", F.row_number().over(window).alias("rank"), F.count("*").over(size_of).alias("have")).where("have = need and rank <= 2")
    entry = ranked.groupBy("item_id", "part", "a").agg(*(F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}{r}") for r in (1, 2) for c in ("word", "at")))
    entry = work.keep(entry.select("item_id", "part", "word1", "at1", F.coalesce("word2", "word1").alias("word2"), F.coalesce("at2", "at1").alias("at2")).distinct(), "entries")
    index = work.keep(postings(docs, sc.broadcast(bitmap(entry.select(F.explode(F.array("word1", "word2")).alias("word"))))), "postings")
    entered = entry.join(index.withColumnRenamed("word", "word1"), "word1").select("item_id", "part", "row", "doc_id", F.col("word2").alias("word"), (F.col("pos") - F.col("at1")).alias("diagonal"), "at1", "at2")
    entered = entered.withColumn("pos", F.col("diagonal") + F.col("at2"))
    if slop:
        # in any order: the second word stands anywhere within the stretch around the rarest, which is at diagonal + at1
        reach = size + slop - 1
        entered = entered.withColumn("pos", F.explode(F.sequence(F.col("diagonal") + F.col("at1") - reach, F.col("diagonal") + F.col("at1") + reach)))
    same = ["row", "word", "pos"]
    places = index.select(*same, F.col("doc_id").alias("doc2"))
    lines = entered.join(places, (F.col("doc_id").eqNullSafe(F.col("doc2"))) & (entered["row"] == places["row"]) & (entered["word"] == places["word"]) & (entered["pos"] == places["pos"]), "left_semi")
    lines = lines.select("item_id", "part", "row", "doc_id", "diagonal").distinct().join(own, ["item_id", "part"])
    found = lines.groupBy("row", "doc_id").agg(F.collect_list(F.struct("item_id", "diagonal", "words")).alias("found"))
    found = found.select(F.col("row").alias("row2"), F.col("doc_id").alias("doc2"), "found")
    texts = keyed(docs)
    met = texts.join(found, (texts["row"] == found["row2"]) & texts["doc_id"].eqNullSafe(found["doc2"])).select("row", "doc_id", "text", "found")
    return met.mapInArrow(aligned(size, slop), "row long, doc_id long, item_id string, start long, stop long, exact boolean").distinct()


def digest(frames):
    """For mapInPandas over (row, doc_id, hits): n_hit and the items of each text."""
    for f in frames:
        out = []
        for row, doc, hits in zip(f["row"], f["doc_id"], f["hits"]):
            last = n = 0
            for a, b in sorted((h["start"], h["stop"]) for h in hits):
                n += max(0, b - max(a, last))
                last = max(last, b)
            ids = sorted({h["item_id"] for h in hits})
            out.append((row, doc, n, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()))
        made = pd.DataFrame(out, columns=["row", "doc_id", "n_hit", "n_items", "items_sha256"])
        yield made.astype({"doc_id": "Int64"})


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    hits = find_matches(docs, items, size).where("exact")
    hits = hits.groupBy("row", "doc_id").agg(F.collect_list(F.struct("item_id", "start", "stop")).alias("hits"))
    hits = hits.mapInPandas(digest, "row long, doc_id long, n_hit long, n_items long, items_sha256 string").withColumnsRenamed({"row": "row2", "doc_id": "doc2"})
    lengths = doc_lengths(docs)
    joined = lengths.join(hits, (lengths["row"] == hits["row2"]) & lengths["doc_id"].eqNullSafe(hits["doc2"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "row", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("row")


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go."""
    bad = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("row").alias("row_"), F.col("doc_id").alias("doc_id_")).distinct()
    whole = whole_rows(docs)
    return whole.join(bad, same_row(whole, bad), "left_anti").select("doc.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS g
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT s.doc_id, bw.item_id, s.i, s.n FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM starts) s JOIN bw ON bw.g = s.g AND bw.n = s.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN ids ON ids.doc_id = d.doc_id
"""
QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLES = {"op3_decontaminate": ORACLE}
