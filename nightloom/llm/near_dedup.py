"""Near-duplicate classes by MinHash: universal hash minima, banding, signatures, components.

1. Each text becomes the set of its distinct word shingles (64-bit hashes), a 128-bit hash of
   that set, ``bands * rows`` minima of universal hashes, and a byte of each minimum.
2. Texts with the same set form one class, whose node is its smallest doc_id; only nodes go on.
3. Nodes that share a band meet in a bucket. First, each node is held against one pivot, the
   most connected node of its buckets, so that a group of copies needs one pair per member.
4. Buckets that still hold nodes of several components are compared whole, in blocks of bounded size
   that tasks share: first by the signatures' bytes alone, which leaves the nodes with an agreeing
   partner; only these nodes' sets are sent to their blocks. Agreeing pairs are confirmed within the
   block, and only links that join what the block has not joined yet leave it. There is no cap on
   buckets or pairs.
5. Every link is confirmed on full sets (100 * intersection >= 100 s * union).
6. Components: alternating large-star and small-star rounds on the links until nothing changes.

At the threshold s = 0.8, 30 bands of 5 rows miss a link with probability (1 - 0.8^5)^30 < 7e-6.

Defined results: null or word-less text has an empty set, links with nothing and is kept. Rows
that share a doc_id share a component's name. A row without doc_id takes part in its class but is no
node; if its class has no other row its component is null and it is kept. Very long texts are compared
whole. An empty table gives an empty result. The stage keeps all columns, whatever their names, and of
rows equal in doc_id and text one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, Workspace, chain, documents, mix, salted, same_row, text_key, tokens, whole_rows

BANDS, ROWS = 30, 5
#: Signature bytes may disagree so much below the threshold before a pair is dropped unseen:
#: 150 bytes, standard deviation 0.033 at 0.8.
SLACK = 0.15
#: A block holds about so many nodes and shingles at most.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Bytes of text that are shingled at once: arrays of 64 bits for each byte stay small.
PIECE = 1 << 18


def shingle_sets(column, words: int):
    """Yields (row, sorted distinct shingle hashes) for every text."""
    for first, bounds, h, *_ in tokens(column, piece=PIECE):
        grams = chain(*(h[i : len(h) - words + 1 + i] for i in range(words))) if len(h) >= words else h[:0]
        for i in range(len(bounds) - 1):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= words:
                yield first + i, np.unique(grams[a : b - words + 1])
            elif b > a:
                yield first + i, np.array([chain(*(h[j : j + 1] for j in range(a, b)))[0]], np.uint64)
            else:
                yield first + i, h[:0]


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each universal hash a * x + b over the set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        values = x[None, i : i + 512] * a[:, None]
        values += b[:, None]
        np.minimum(out, values.min(1), out=out)
    return out


def set_hash(hashes: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        one = np.bitwise_xor.reduce(mix(hashes)) if len(hashes) else np.uint64(0)
        two = np.add.reduce(mix(hashes ^ np.uint64(0x5851F42D4C957F2D))) if len(hashes) else np.uint64(0)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, row, n_shingles, the set's hash, band keys and signature bytes of every row."""

    def run(batches):
        a, b = coefficients(bands * rows)
        salt = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            n, one, two, keys, sig = [], [], [], [], []
            for _, s in shingle_sets(batch.column(1), words):
                n.append(len(s))
                h = set_hash(s)
                one.append(h[0])
                two.append(h[1])
                if len(s):
                    m = minima(s, a, b)
                    grid = m.reshape(bands, rows).astype(np.uint64)
                    keys.append(chain(salt, *grid.T).view(np.int64))
                    sig.append((m >> np.uint32(24) ^ m >> np.uint32(7)).astype(np.uint8).tobytes())
                else:
                    keys.append(np.zeros(0, np.int64))
                    sig.append(b"")
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            offs = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat)), pa.array(sig, pa.binary())],
                ["doc_id", "row", "n_shingles", "h1", "h2", "keys", "sig"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("row")).mapInArrow(run, "doc_id long, row long, n_shingles long, h1 long, h2 long, keys array<long>, sig binary")


def full_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, set (array<long>) of the given nodes (node, h1, h2)."""

    def run(batches):
        for batch in batches:
            one, two, sets = [], [], []
            for _, s in shingle_sets(batch.column(1), words):
                h = set_hash(s)
                one.append(h[0])
                two.append(h[1])
                sets.append(s.view(np.int64))
            offs = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], ["node", "h1", "h2", "set"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).join(nodes.select("node"), "node", "left_semi")
    made = wanted.mapInArrow(run, "node long, h1 long, h2 long, set array<long>")
    return made.join(nodes, ["node", "h1", "h2"], "left_semi").dropDuplicates(["node", "h1", "h2"]).select("node", "set")


def confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets overlap by the threshold; a may be hot, b is not."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = full_sets(docs, nodes.join(ends, "node", "left_semi"), words)
    both = salted(pairs, sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), ["a"]).join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    shared = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return both.select("a", "b", shared.alias("i"), (F.size("set_a") + F.size("set_b")).cast("long").alias("t")).where(100 * F.col("i") >= threshold * (F.col("t") - F.col("i"))).select("a", "b")


def bytes_needed(least: float, n: int) -> int:
    """So many of n bytes agree at a similarity of `least`, chance agreement of 1/256 included."""
    return int(np.ceil(n * (least + (1 - least) / 256)))


def alike(need: int):
    """A function for mapInPandas over (a, b, sig_a, sig_b): the pairs that agree in enough bytes."""

    def run(frames):
        for f in frames:
            if len(f):
                x, y = (np.frombuffer(b"".join(f[c]), np.uint8).reshape(len(f), -1) for c in ("sig_a", "sig_b"))
                f = f[(x == y).sum(1) >= need]
            yield f[["a", "b"]]

    return run


def by_blocks(work_on, schema: list[str]):
    """A function for mapInPandas over rows sorted by (bucket, i, j): work_on(the rows of each)."""

    def run(frames):
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            key = frame[["bucket", "i", "j"]].to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()]
            found = []
            for s, e in zip(cuts, cuts[1:]):
                found.extend(work_on(frame.iloc[s:e]))
            rest = frame.iloc[cuts[-1] :]
            yield pd.DataFrame(found, columns=schema, dtype="int64")
        if rest is not None and len(rest):
            yield pd.DataFrame(work_on(rest), columns=schema, dtype="int64")

    return run


class Block:
    """The rows of a bucket, or of two of its blocks, and which of their pairs may be links."""

    def __init__(self, rows: pd.DataFrame, need: int, bands: int):
        keys = np.concatenate(rows["keys"].to_numpy()).reshape(len(rows), bands)
        own = (keys == rows["bucket"].iloc[0]).any(1)
        rows, self.keys = rows[own], keys[own]
        self.rows, self.need = rows, need
        self.node, side = rows["node"].to_numpy(), rows["blk"].to_numpy()
        self.sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(len(rows), -1)
        self.size = rows["n_shingles"].to_numpy()
        self.band = int(np.flatnonzero(self.keys[0] == rows["bucket"].iloc[0])[0]) if len(rows) else 0
        self.group = np.unique(rows["grp"].to_numpy(), return_inverse=True)[1]
        self.same = len(rows) and rows["i"].iloc[0] == rows["j"].iloc[0]
        self.left = np.flatnonzero(side == rows["i"].iloc[0]) if len(rows) else np.zeros(0, np.int64)
        self.right = self.left if self.same else np.flatnonzero(side == rows["j"].iloc[0]) if len(rows) else self.left

    def partners(self, x: int, threshold: int) -> np.ndarray:
        """Rows of other groups that agree with row x, in the first band that they share."""
        y = self.right[self.group[self.right] != self.group[x]]
        if self.same:
            y = y[y > x]
        y = y[100 * np.minimum(self.size[y], self.size[x]) >= threshold * np.maximum(self.size[y], self.size[x])]
        y = y[(self.sig[y] == self.sig[x]).sum(1) >= self.need]
        return y[(self.keys[y] == self.keys[x]).argmax(1) == self.band]


def agreeing(threshold: int, need: int, bands: int):
    """For by_blocks: the rows with a partner."""

    def rows_of(rows: pd.DataFrame):
        block, found = Block(rows, need, bands), set()
        for x in block.left:
            y = block.partners(x, threshold)
            if len(y):
                found.add(int(x))
                found.update(y.tolist())
        return list(block.rows.iloc[sorted(found)][["bucket", "i", "j", "node", "grp", "blk"]].itertuples(index=False, name=None))

    return by_blocks(rows_of, ["bucket", "i", "j", "node", "grp", "blk"])


def linked(threshold: int, need: int, bands: int):
    """For by_blocks: links across groups, confirmed on full sets, unless the block's links so far
    already join the pair. So at most one link for each row leaves a block, however many of its pairs
    are alike, and the components are those of all links."""

    def links_of(rows: pd.DataFrame):
        block = Block(rows, need, bands)
        size, group, node = block.size, block.group, block.node
        sets = [np.asarray(s, np.int64).view(np.uint64) for s in block.rows["set"]]
        found = []
        for x in block.left:
            others = block.partners(x, threshold)
            if not len(others):
                continue
            flat = np.concatenate([sets[y] for y in others])
            at = np.minimum(np.searchsorted(sets[x], flat), size[x] - 1)
            shared = np.add.reduceat((sets[x][at] == flat).astype(np.int64), np.cumsum(size[others]) - size[others])
            for y in others[100 * shared >= threshold * (size[others] + size[x] - shared)]:
                if group[x] != group[y]:
                    group[group == group[y]] = group[x]
                    found.append((min(node[x], node[y]), max(node[x], node[y])))
        return found

    return by_blocks(links_of, ["a", "b"])


def across(met: DataFrame, group: DataFrame, sig: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, threshold: int, need: int, bands: int, work: Workspace) -> DataFrame:
    """Confirmed links (a < b) in buckets that hold nodes of several groups (node, grp)."""
    grouped = met.join(group, "node", "left").select("bucket", "node", "n_shingles", F.coalesce("grp", "node").alias("grp"))
    split = grouped.groupBy("bucket").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count("*").alias("size"), F.sum("n_shingles").alias("weight")).where("lo <> hi").select("bucket", "size", "weight")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    laid = grouped.join(split, "bucket").select("bucket", "node", "grp", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("blk"))
    laid = laid.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("bucket", "node", "grp", "blk", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"))
    placed = laid.join(sig, "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    alive = work.keep(placed.mapInPandas(agreeing(threshold, need, bands), "bucket long, i long, j long, node long, grp long, blk long"), "alive")
    wanted = nodes.join(alive.select("node").distinct(), "node", "left_semi")
    sets = work.keep(full_sets(docs, wanted, words), "sets")
    placed = alive.join(sig, "node").join(sets, "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return placed.mapInPandas(linked(threshold, need, bands), "a long, b long")


def components(links: DataFrame, work: Workspace, name: str = "", limit: int = 64) -> DataFrame:
    """node, root: the smallest node that links (a, b) reach, by alternating large-star and small-star.

    Every round is written to the shared folder. Hubs are never gathered: a star's centre is a
    minimum, aggregated before the shuffle, and is joined back to its edges.
    """

    def edges(df, u, v):
        return df.select(F.least(u, v).alias("lo"), F.greatest(u, v).alias("hi")).where("lo <> hi").distinct()

    now = work.keep(edges(links, "a", "b"), f"{name}edges0")
    state = None
    for n in range(1, limit + 1):
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        centre = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(centre, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.select("lo", "hi").where("lo <> hi").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("x"), F.col("m")), F.struct(F.col("hi").alias("x"), F.col("m")))).alias("e"))
        now = work.keep(edges(small, "e.x", "e.m"), f"{name}edges{n}")
        seen = now.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("lo", "hi")), F.lit(0)).alias("x")).first()
        work.drop(f"{name}edges{n - 1}")
        if seen == state or not seen["n"]:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        state = seen
    raise RuntimeError(f"components did not settle within {limit} rounds")


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, and row, a hash of its text.

    ``threshold`` is the least Jaccard similarity in per cent.
    """
    spark: SparkSession = docs.sparkSession
    work = Workspace(spark, "near", BATCH_BYTES)
    signed = work.keep(signatures(docs, words, bands, rows), "signed")
    classes = work.keep(signed.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("node")), "classes")
    nodes = classes.where("node is not null").select("node", "h1", "h2")
    own = signed.withColumnRenamed("doc_id", "node").join(nodes, ["node", "h1", "h2"], "left_semi")

    member = own.select("node", "n_shingles", F.explode("keys").alias("bucket"))
    crowd = member.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("bucket", "n")
    met = work.keep(member.join(crowd, "bucket"), "met")
    # the most connected node of each bucket is its pivot; each node tries the best one it meets
    ties = met.groupBy("node").agg(F.sum("n").alias("ties"))
    ranked = met.join(ties, "node")
    pivot = ranked.groupBy("bucket").agg(F.min(F.struct((-F.col("ties")).alias("rank"), "node")).alias("p")).select("bucket", F.col("p.node").alias("a"), (-F.col("p.rank")).alias("top"))
    tried = met.join(pivot, "bucket").where("a <> node")
    best = tried.groupBy(F.col("node").alias("b")).agg(F.min(F.struct((-F.col("top")).alias("rank"), "a")).alias("p")).select("b", F.col("p.a").alias("a"))
    best = work.keep(best, "tries")
    sig = work.keep(own.select("node", "n_shingles", "sig", "keys").join(met.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "signatures")
    need = bytes_needed(threshold / 100 - SLACK, bands * rows)
    end = lambda c: sig.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"))
    pairs = work.keep(salted(best, end("a"), ["a"]).join(end("b"), "b").select("a", "b", "sig_a", "sig_b").mapInPandas(alike(need), "a long, b long"), "tried")
    links = work.keep(confirmed(pairs, docs, nodes, words, threshold), "star")
    root = components(links, work, "star")
    # then whatever is still apart
    more = across(met, root.withColumnRenamed("root", "grp"), sig, docs, nodes, words, threshold, need, bands, work)
    links = links.unionByName(work.keep(more, "more_links"))
    work.drop("met", "alive", "sets", "signatures", "tries", "tried")
    root = components(links, work, "all")
    named = classes.join(root, "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("component_id"))
    out = signed.select("doc_id", "row", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), "row")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=2, threshold=80).drop("row")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group, the document with the smallest doc_id stays (shingles of five words).

    Rows equal in doc_id and text stay as one row.
    """
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("doc_id_"), F.col("row").alias("row_")).distinct()
    whole = whole_rows(docs)
    return whole.join(kept, same_row(whole, kept), "left_semi").dropDuplicates(["doc_id", "row"]).select("doc.*")


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM sets
  UNION
  SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) c ON c.node = s.doc_id
"""

QUERIES = {"op5_near_dedup": op5_near_dedup}
ORACLES = {"op5_near_dedup": ORACLE}
