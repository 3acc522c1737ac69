"""Line dedup by winnowing over line hashes.

A document is the sequence of its lines that hold a word, each a 128-bit hash of the stripped line.
A run is a stretch of consecutive such lines with at least ``min_words`` words.

1. Winnowing: from every line a window reaches forward until it holds ``min_words`` words. The least
   line hash of each window (the last one, if equal) is selected. Two copies of a run hold the run's
   first window, so both select the same line of it: only selected positions are stored and compared.
2. Join: positions of equal hashes meet. A position whose hash occurs nowhere else falls away. The
   windows that selected a remaining one are verified by a hash of all their lines; of equal windows,
   every later one is matched with the first one, an aggregated minimum, so that a hash that many
   unrelated lines share doesn't pair them.
3. Extend: a match goes on line by line, as long as the lines that follow are equal. (To the left there
   is nothing to extend: if the lines before are equal too, then the window that starts there is
   matched.) At less than ``min_words`` words behind its window it ends, since a longer one is
   followed by a window of its own. Where occurrences go on differently, a match that the first one
   ends is extended along the earliest occurrence that goes on alike.
4. Delete: every line of a matched run that has an earlier occurrence goes, "earlier" by
   (doc_id, line). So the first occurrence stays, in whole.

The outcome is exact: a line goes if and only if it lies in a run of at least ``min_words`` words
that occurs earlier. No group is gathered, and hot hashes are split over tasks.

Defined results: null text stays null with no lines. Lines without a word are never compared;
they go with the line before them. An overlapping repeat within one document collapses to its
first occurrence. A null doc_id sorts first. Rows are told apart by (doc_id, hash of the text);
of repeated rows (same doc_id and text) each is treated alike, as one document. Very long texts are
compared whole. An empty table gives an empty result. Other columns, whatever their names, are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import BATCH_BYTES, SPACES, Workspace, chain, documents, salted, slices, text_key

MIN_WORDS = 50


def selected(words: np.ndarray, hashes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The end of the window from each line that has one, and the position that it selects."""
    total = np.concatenate([[0], np.cumsum(words)])
    if total[-1] < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.searchsorted(total, total[:-1] + least, "left")
    end = end[end <= len(words)]
    start = np.arange(len(end))
    best, at = hashes[start].copy(), start.copy()
    size = end - start
    for i in range(1, int(size.max())):
        on = np.flatnonzero(size > i)
        on = on[hashes[on + i] <= best[on]]
        best[on], at[on] = hashes[on + i], on + i
    return end, at


def lists(rows: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind)))


def lines(docs: DataFrame, least: int) -> DataFrame:
    """row, doc_id, both halves and the words of each line, and the selected positions."""

    def run(batches):
        strip = SPACES.encode()
        for batch in batches:
            at, one, two, count, marks = [], [], [], [], []
            for i, text in enumerate(batch.column(2)):
                text = text.as_py()
                if not text:
                    continue
                kept = [x for x in (line.strip(strip) for line in text.encode().split(b"\n")) if x]
                words = np.fromiter((len(x.split()) for x in kept), np.int64, len(kept))
                if words.sum() < least:
                    continue
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in kept), np.uint64).reshape(-1, 2)
                at.append(i)
                one.append(np.ascontiguousarray(digest[:, 0]).view(np.int64))
                two.append(np.ascontiguousarray(digest[:, 1]).view(np.int64))
                count.append(words)
                marks.append(np.unique(selected(words, digest[:, 0], least)[1]))
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), lists(one, np.int64), lists(two, np.int64), lists(count, np.int64), lists(marks, np.int64)], ["row", "doc_id", "h1", "h2", "words", "marks"])

    return docs.mapInArrow(run, "row long, doc_id long, h1 array<long>, h2 array<long>, words array<long>, marks array<long>")


def windows(found: DataFrame, least: int) -> DataFrame:
    """row, doc_id, start, lines, hash (w1, w2) of the windows that selected a live position, and the
    hashes of the window with 1, 2, ... of the lines that follow (up to ``least`` - 1 words)."""

    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("row", "start", "lines", "w1", "w2", "n1", "n2")}
            for i in range(batch.num_rows):
                h = [np.array(batch.column(c)[i].values, np.int64).view(np.uint64) for c in (2, 3)]
                words, live = (np.array(batch.column(c)[i].values, np.int64) for c in (4, 5))
                end, mark = selected(words, h[0], least)
                start = np.flatnonzero(np.isin(mark, live))
                end = end[start]
                total = np.concatenate([[0], np.cumsum(words)])
                size, further = end - start, np.searchsorted(total, total[end] + least, "left") - 1 - end
                offset = np.concatenate([[0], np.cumsum(further)])
                state = [np.zeros(len(start), np.uint64), np.ones(len(start), np.uint64)]
                whole, more = [s.copy() for s in state], [np.zeros(offset[-1], np.uint64) for _ in state]
                for k in range(int((size + further).max(initial=0))):
                    on = np.flatnonzero(size + further > k)
                    inside, beyond = on[size[on] == k + 1], on[size[on] <= k]
                    for half in (0, 1):
                        state[half][on] = chain(state[half][on], h[half][start[on] + k])
                        whole[half][inside] = state[half][inside]
                        more[half][offset[beyond] + k - size[beyond]] = state[half][beyond]
                out["row"].append(np.full(len(start), i))
                for c, x in (("start", start), ("lines", size), ("w1", whole[0].view(np.int64)), ("w2", whole[1].view(np.int64))):
                    out[c].append(x)
                for c, x in zip(("n1", "n2"), more):
                    out[c].extend(x[a:b].view(np.int64) for a, b in zip(offset[:-1], offset[1:]))
            flat = {c: np.concatenate(out[c]).astype(np.int64) if out[c] else np.zeros(0, np.int64) for c in ("row", "start", "lines", "w1", "w2")}
            rows = pa.array(flat["row"])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(flat[c]) for c in ("start", "lines", "w1", "w2")), *(lists(out[c], np.int64) for c in ("n1", "n2"))], ["row", "doc_id", "start", "lines", "w1", "w2", "n1", "n2"])

    return found.select("row", "doc_id", "h1", "h2", "words", "live").mapInArrow(run, "row long, doc_id long, start long, lines long, w1 long, w2 long, n1 array<long>, n2 array<long>")


def place() -> Column:
    """A position, in the order of (doc_id, line); null ids first."""
    return F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row", "start")


def agreeing(left1, left2, right1, right2) -> Column:
    """How many leading hashes agree."""
    pairs = F.arrays_zip(left1.alias("a"), left2.alias("b"), right1.alias("c"), right2.alias("d"))
    equal = F.transform(pairs, lambda x: F.coalesce((x["a"] == x["c"]) & (x["b"] == x["d"]), F.lit(False)))
    ends = F.array_position(equal, False)
    return F.when(ends == 0, F.size(equal).cast("long")).otherwise(ends - 1)


def cut(frames):
    """For mapInArrow over (..., text, spans): the text without the lines of the spans, and counts."""
    strip = SPACES
    for batch in (piece for frame in frames for piece in slices(frame)):
        names = batch.schema.names
        texts, found = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
        text_out, n_lines, n_cut = [], [], []
        for text, spans_ in zip(texts, found):
            if text is None:
                text_out.append(None)
                n_lines.append(0)
                n_cut.append(0)
                continue
            lines = text.split("\n")
            has = [bool(x.strip(strip)) for x in lines]
            total = sum(has)
            if not spans_:
                text_out.append(text)
                n_lines.append(total)
                n_cut.append(0)
                continue
            gone = np.zeros(total + 1, np.int64)
            for s in spans_:
                gone[s["first"]] += 1
                gone[s["first"] + s["lines"]] -= 1
            gone = np.cumsum(gone)[:total] > 0
            keep, at, last = [], 0, False
            for line, word in zip(lines, has):
                if word:
                    last = bool(gone[at])
                    at += 1
                if not last:
                    keep.append(line)
            text_out.append("\n".join(keep))
            n_lines.append(total)
            n_cut.append(int(gone.sum()))
        columns = [batch.column(c) for c in names if c not in ("text", "spans")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(text_out, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_cut, pa.int64())], [*(c for c in names if c not in ("text", "spans")), "text", "n_lines", "n_removed"])


def repeated_spans(docs: DataFrame, min_words: int, work: Workspace) -> DataFrame:
    """row, doc_id, spans: the matched lines of each row that occur earlier."""
    every = work.keep(lines(docs.select("row", "doc_id", "text"), min_words), "lines")
    # repeated rows are one document
    marked = every.select("row", "doc_id", F.explode("marks").alias("start"), "h1", "h2").select("row", "doc_id", "start", F.element_at("h1", F.col("start").cast("int") + 1).alias("m1"), F.element_at("h2", F.col("start").cast("int") + 1).alias("m2"))
    marked = work.keep(marked, "selected")
    often = marked.groupBy("m1", "m2").agg(F.min(place()).alias("a"), F.max(place()).alias("b")).where("a <> b").select("m1", "m2")
    live = salted(marked, often, ["m1", "m2"], "left_semi").groupBy("row", "doc_id").agg(F.collect_set("start").alias("live"))
    live = live.withColumnsRenamed({"row": "row_", "doc_id": "doc_id_"})
    once = every.dropDuplicates(["row", "doc_id"])
    found = once.join(live, (once["row"] == live["row_"]) & once["doc_id"].eqNullSafe(live["doc_id_"]))
    held = work.keep(windows(found, min_words), "windows")
    first = held.groupBy("w1", "w2").agg(F.min(F.struct(place().alias("at"), F.col("n1").alias("f1"), F.col("n2").alias("f2"))).alias("first"), F.count("*").alias("n")).where("n > 1").select("w1", "w2", "first.at", "first.f1", "first.f2", "n")
    later = salted(held, first, ["w1", "w2"]).where(place() != F.col("at"))
    later = work.keep(later.select("row", "doc_id", "start", "lines", "w1", "w2", "n", F.size("n1").alias("room"), agreeing(F.col("n1"), F.col("n2"), F.col("f1"), F.col("f2")).alias("more")), "matches")
    # windows of which the first occurrence ends early: other occurrences may go on alike
    open_ = later.where("more < room and n > 2").select("w1", "w2").distinct()
    steps = salted(held, open_, ["w1", "w2"], "left_semi").select("row", "doc_id", "start", "lines", F.posexplode(F.arrays_zip("n1", "n2")).alias("more", "x"))
    steps = work.keep(steps.select("row", "doc_id", "start", "lines", (F.col("more") + 1).cast("long").alias("more"), F.col("x.n1").alias("w1"), F.col("x.n2").alias("w2")), "steps")
    earliest = steps.groupBy("w1", "w2").agg(F.min(place()).alias("at"), F.count("*").alias("n")).where("n > 1").select("w1", "w2", "at")
    further = salted(steps, earliest, ["w1", "w2"]).where(place() != F.col("at"))
    spans = later.select("row", "doc_id", F.col("start").alias("first"), (F.col("lines") + F.col("more")).alias("lines")).unionByName(further.select("row", "doc_id", F.col("start").alias("first"), (F.col("lines") + F.col("more")).alias("lines")))
    # a document's spans are bounded by its lines
    spans = spans.groupBy("row", "doc_id", "first").agg(F.max("lines").alias("lines"))
    return spans.groupBy("row", "doc_id").agg(F.collect_list(F.struct("first", "lines")).alias("spans"))


def deduped(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """rest (the other columns), doc_id, the remaining text, n_lines (with a word) and n_removed of every row."""
    work = Workspace(docs.sparkSession, "lines", BATCH_BYTES)
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c != "text"]
    base = docs.select(F.struct(*quoted).alias("rest"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("row"))
    spans = repeated_spans(base, min_words, work).withColumnsRenamed({"row": "row_", "doc_id": "doc_id_"})
    joined = base.join(spans, (base["row"] == spans["row_"]) & base["doc_id"].eqNullSafe(spans["doc_id_"]), "left").select("rest", "doc_id", "text", "spans")
    fields = [f for f in joined.schema.fields if f.name in ("rest", "doc_id")]
    return joined.mapInArrow(cut, StructType([*fields, StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_removed", LongType())]))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, the remaining text, n_lines (with a word) and n_removed of every row."""
    return deduped(docs.select("doc_id", "text"), min_words).drop("rest")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts lose their repeated runs; a document of which nothing is left goes."""
    out = deduped(docs).where("n_removed = 0 or n_removed < n_lines")
    columns = []
    for c in docs.columns:
        own = F.col("rest")[c]
        if c == "text":
            own = F.col("text").cast(docs.schema[c].dataType)
        elif c == "n_chars":
            own = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(own)
        columns.append(own.alias(c))
    return out.select(*columns)


QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLES: dict[str, str] = {}
