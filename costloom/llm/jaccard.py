"""Exact n-gram Jaccard join as a grouped prefix join, and its near-duplicate components.

A document is the set of its distinct word n-grams, held as 64-bit hashes. Two documents link when
the Jaccard similarity of their sets is at least ``percent`` / 100.

1. *Order.* One count sketch over all shingles (a fixed number of counters, summed in a tree) gives
   every shingle a level; sets are ordered rarest first by (level, hash). Any such order is right for
   prefix filtering, and a rare-first one keeps common passages out of the prefixes.
2. *Group.* Equal sets are one class. Classes with identical prefixes and size are one group, and
   only groups are joined.
3. *Filter.* Two linked sets share a token in their prefixes. Group pairs from a common token must
   pass the size, position and prefix-overlap bounds.
4. *Expand and verify.* Members of the remaining group pairs are compared by their whole sets.

Links inside a dense cluster would be quadratic, so this runs twice: first each group is only paired
with its token's leader (the group where the token comes earliest), which ties most of a cluster
together; then all group pairs that still lie in different components are verified. What is skipped
are pairs already known to be connected, so components are exact.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from costloom.llm.common import durable, frugal, mix64, small_batches, text_slices, token_hashes, valid_text, WORD
from costloom.llm.components import connected_components

#: Counters of the sketch, and the rows they are summed in.
COUNTERS, CHUNKS = 1 << 20, 64
_C = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: list, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (bytes or null).

    Texts with fewer words are one shingle; texts without words have none.
    """
    h, owner = token_hashes(texts, WORD)
    counts = np.bincount(owner, minlength=len(texts))
    ends = np.cumsum(counts)
    out = []
    if len(h) >= words:
        s = h[: len(h) - words + 1]
        for k in range(1, words):
            s = mix64(s * _C + h[k : len(h) - words + 1 + k])
    else:
        s = h[:0]
    for n, end in zip(counts.tolist(), ends.tolist()):
        if n >= words:
            out.append(np.unique(s[end - n : end - words + 1]))
        elif n:
            x = np.full(1, n, np.uint64)
            for v in h[end - n : end]:
                x = mix64(x * _C + v)
            out.append(x)
        else:
            out.append(h[:0])
    return out


def batched_sets(column: pa.Array, words: int):
    """The shingle sets of a column of texts, a slice at a time."""
    for lo, hi, part in text_slices(column, 1_000_000):
        yield lo, hi, shingle_sets(part.cast(pa.binary()).to_pylist(), words)


def shingle_levels(docs: DataFrame, words: int) -> np.ndarray:
    """A level for each counter of the sketch: the rounded log of how many (document, shingle) pairs fall on it."""

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, _, sets in batched_sets(batch.column(0), words):
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                total += np.bincount((flat & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        parts = [zlib.compress(p.tobytes(), 1) for p in np.split(total, CHUNKS)]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([task] * CHUNKS, pa.int64()), pa.array(parts, pa.binary())], ["chunk", "task", "counts"])

    def add(data):
        total = sum(np.frombuffer(zlib.decompress(b), np.int64) for b in data["counts"].to_pylist())
        return pa.table({"chunk": data["chunk"].slice(0, 1), "task": pa.array([data["task"][0].as_py() // 64], pa.int64()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    shape = "chunk int, task long, counts binary"
    parts = docs.select("text").mapInArrow(frugal(count), shape)
    # a tree of sums: at most 64 rows a group in the first layer, then one row for 64 tasks
    for layer in (F.floor(F.col("task") / 64), F.lit(0)):
        parts = parts.groupBy("chunk", layer.alias("part")).applyInArrow(add, shape)
    total = np.zeros(COUNTERS, np.int64)
    size = COUNTERS // CHUNKS
    for r in parts.collect():
        total[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return np.minimum(255, np.round(4 * np.log2(total + 1))).astype(np.uint8)


def prefix_length(n, percent: int):
    """Rarest tokens of a set of ``n`` of which linked sets share at least one."""
    return n - -(-n * percent // 100) + 1


def prefixes(docs: DataFrame, levels: np.ndarray, words: int, percent: int, hot_level: int) -> DataFrame:
    """(doc_id, n, signature, group_key, prefix, hot_at) per document with a set.

    ``hot_at`` is the first prefix position whose level is at least ``hot_level``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        level = shared.value
        for batch in batches:
            ns, sigs, keys, prefs, hots = [], [], [], [], []
            for _, _, sets in batched_sets(batch.column(1), words):
                for s in sets:
                    ns.append(len(s))
                    if not len(s):
                        sigs.append(None), keys.append(None), prefs.append([]), hots.append(0)
                        continue
                    own = level[s & np.uint64(COUNTERS - 1)]
                    p = prefix_length(len(s), percent)
                    order = np.argsort(own, kind="stable")[:p]
                    pref = s[order]
                    sigs.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    keys.append(hashlib.blake2b(pref.tobytes() + len(s).to_bytes(8, "little"), digest_size=16).digest())
                    prefs.append(pref.view(np.int64))
                    hots.append(int(np.searchsorted(own[order], hot_level)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int32()), pa.array(sigs, pa.binary()), pa.array(keys, pa.binary()), pa.array(prefs, pa.list_(pa.int64())), pa.array(hots, pa.int32())],
                ["doc_id", "n", "signature", "group_key", "prefix", "hot_at"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {kind}, n int, signature binary, group_key binary, prefix array<long>, hot_at int")


def least_overlap(n1: Column, n2: Column, percent: int) -> Column:
    """The smallest intersection with which sets of these sizes link."""
    return F.ceil((n1 + n2) * percent / F.lit(100.0 + percent) - 1e-9)


def sizes_fit(n1: Column, n2: Column, percent: int) -> Column:
    return 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)


def positions_fit(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Whether a token at these positions can be the first common one of linked sets."""
    return F.least(n1 - p1, n2 - p2) >= least_overlap(n1, n2, percent)


def overlaps_fit(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Group pairs (a, b) whose common prefix tokens leave room for enough overlap."""
    left = groups.select(F.col("gid").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa"))
    right = groups.select(F.col("gid").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("pa", "pb"))
    rest = F.greatest(F.col("na") - F.size("pa"), F.col("nb") - F.size("pb"))
    return both.where(common + rest >= least_overlap(F.col("na"), F.col("nb"), percent)).select("a", "b")


def verify(pairs: DataFrame, docs: DataFrame, words: int, percent: int, per_slice: int = 200) -> DataFrame:
    """The pairs (a, b) of ``pairs`` that link, by their whole sets.

    The pairs of one ``a`` are dealt into slices of about ``per_slice``; a slice gets one copy of a's
    text and is read as a stream, so a document with a million partners is many small pieces of work.
    Only texts whose doc_id falls on a marked bit of a fixed-size bitmap of wanted ids are shuffled.
    """
    bits = 1 << 22
    pairs = durable(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    spot = F.pmod(F.xxhash64("id"), F.lit(bits))
    marks = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(F.floor(spot / 32).cast("int").alias("word"), (spot % 32).cast("int").alias("bit"))
    # at most bits / 32 rows
    marks = marks.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask")).toArrow()
    bitmap = np.zeros(bits // 32, np.uint32)
    bitmap[marks["word"].to_numpy()] = marks["mask"].to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def wanted(batches):
        for batch in batches:
            at = batch.column(2).to_numpy()
            hit = (shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1)
            yield batch.filter(pa.array(hit.astype(bool))).select(["id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text").select("id", "text", spot.cast("int").alias("spot"))
    texts = rows.mapInArrow(frugal(wanted), f"id {kind}, text string")
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > per_slice)
    slices = F.coalesce(F.ceil(F.col("m") / per_slice), F.lit(1))
    placed = durable(pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), slices).alias("slice")), "slices")
    heads = placed.select("a", "slice").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", "slice", F.lit(None).cast(kind).alias("b"), "text")
    partners = placed.join(texts.withColumnRenamed("id", "b"), "b").select("a", "slice", "b", "text")
    ordered = heads.union(partners).repartition("a", "slice").sortWithinPartitions("a", "slice", F.asc_nulls_first("b"))

    def compare(batches):
        at, heads = None, []
        for batch in batches:
            a, piece, b = (batch.column(c).to_pylist() for c in range(3))
            keep = []
            for lo, _, sets in batched_sets(batch.column(3), words):
                for k, s in enumerate(sets, lo):
                    if at != (a[k], piece[k]):
                        at, heads = (a[k], piece[k]), []
                    if b[k] is None:
                        heads.append(s)
                    elif any(linked(s, x, percent) for x in heads):
                        keep.append(k)
            yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])

    return ordered.mapInArrow(frugal(compare), f"a {kind}, b {kind}").distinct()


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two shingle sets are similar enough."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 85, hot_rows: int = 20_000, hot_slices: int = 64, slice_rows: int = 2_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Null and empty texts have no shingles and link with nothing; a null doc_id keeps a null component
    and links with nothing. Rows that repeat a doc_id count as one document holding all their texts.
    The component_id is the smallest doc_id reachable by links. An empty table gives no rows; other
    columns are ignored. Bytes that aren't UTF-8 are read as U+FFFD. No bucket, partner or candidate is capped. ``hot_rows`` and ``hot_slices``
    split frequent tokens in the first round; ``slice_rows`` bounds the blocks of the second.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", valid_text(F.col("text")).alias("text"))
    levels = shingle_levels(docs, words)
    hot_level = int(np.floor(4 * np.log2(hot_rows)))
    sets = durable(prefixes(docs, levels, words, percent, hot_level), "prefixes")
    classes = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("signature", "group_key").agg(F.min("doc_id").alias("node"))
    lead = classes.groupBy("group_key").agg(F.min("node").alias("gid"))
    members = durable(classes.join(lead, "group_key").select("signature", "node", "gid"), "members")
    # a repeated doc_id may lead groups of several texts: its prefixes stay apart
    groups = sets.select("doc_id", "group_key", "n", "prefix", "hot_at").join(lead.withColumnRenamed("gid", "doc_id"), ["doc_id", "group_key"])
    groups = durable(groups.dropDuplicates(["doc_id", "group_key"]).select(F.col("doc_id").alias("gid"), "n", "prefix", "hot_at"), "groups")

    tokens = groups.select("gid", "n", "hot_at", F.posexplode("prefix").alias("pos", "token"))
    salt = F.when(F.col("pos") >= F.col("hot_at"), F.pmod(F.xxhash64("gid"), F.lit(hot_slices))).otherwise(F.lit(0)).cast("int")
    bucket = W.partitionBy("token", "salt").orderBy("pos", "gid")
    hot = F.col("pos") >= F.col("hot_at")
    placed = tokens.select("gid", "n", "pos", "token", salt.alias("salt"), hot.alias("hot"))
    led = placed.select("*", F.first(F.struct("gid", "n", "pos")).over(bucket).alias("lead"), F.lead("gid").over(bucket).alias("next"))
    shared = durable(led.where(F.col("hot") | (F.col("lead.gid") != F.col("gid")) | F.col("next").isNotNull()).drop("next"), "tokens")

    # round 1: every group with its leader, every slice leader of a hot token with the token's leader
    star = shared.select(F.col("lead.gid").alias("a"), F.col("lead.n").alias("na"), F.col("lead.pos").alias("pa"), F.col("gid").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    heads = shared.where(F.col("hot") & (F.col("lead.gid") == F.col("gid"))).select("token", "gid", "n", "pos")
    top = W.partitionBy("token").orderBy("pos", "gid")  # at most hot_slices rows a token
    heads = heads.select("gid", "n", "pos", F.first(F.struct("gid", "n", "pos")).over(top).alias("lead"))
    star = star.union(heads.select("lead.gid", "lead.n", "lead.pos", "gid", "n", "pos"))
    fits = sizes_fit(F.col("na"), F.col("nb"), percent) & positions_fit(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), percent)
    star = star.where((F.col("a") != F.col("b")) & fits).select("a", "b").distinct()
    within = members.where("node <> gid").select(F.col("gid").alias("a"), F.col("node").alias("b"))
    links = durable(verify(overlaps_fit(star, groups, percent).union(within), docs, words, percent), "links")
    found = connected_components(links)

    # round 2: all group pairs that are not in one component yet
    placed = durable(members.join(found.withColumnRenamed("component", "c"), "node", "left").select("gid", "node", F.coalesce("c", "node").alias("c")), "placed")
    span = placed.groupBy("gid").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    rows = durable(shared.select("token", "gid", "n", "pos").join(span, "gid"), "spans")
    open_tokens = rows.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h"), F.ceil(F.count(F.lit(1)) / slice_rows).alias("slices"))
    rows = rows.join(open_tokens.where("l <> h").select("token", "slices"), "token")
    # a frequent token's rows are dealt into slices; each two slices, and each slice with itself, are one block
    own = F.pmod(F.xxhash64("gid"), F.col("slices"))
    x = rows.withColumn("s", own).withColumn("t", F.explode(F.sequence("s", F.col("slices") - 1))).alias("x")
    y = rows.withColumn("t", own).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), "t"))).alias("y")
    apart = (F.col("x.low") != F.col("y.high")) | (F.col("x.high") != F.col("y.low"))
    fits = sizes_fit(F.col("x.n"), F.col("y.n"), percent) & positions_fit(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent)
    block = (F.col("x.token") == F.col("y.token")) & (F.col("x.s") == F.col("y.s")) & (F.col("x.t") == F.col("y.t"))
    once = (F.col("x.gid") < F.col("y.gid")) | ((F.col("x.s") < F.col("x.t")) & (F.col("x.gid") != F.col("y.gid")))
    rest = x.join(y, block & once & apart & fits).select(F.least("x.gid", "y.gid").alias("a"), F.greatest("x.gid", "y.gid").alias("b")).distinct()
    mixed = span.where("low <> high").select(F.col("gid").alias("a"), F.col("gid").alias("b"))
    rest = overlaps_fit(rest, groups, percent).union(mixed)
    one = placed.select(F.col("gid").alias("a"), F.col("node").alias("m"), F.col("c").alias("cm"))
    two = placed.select(F.col("gid").alias("b"), F.col("node").alias("k"), F.col("c").alias("ck"))
    rest = rest.join(one, "a").join(two, "b").where("cm <> ck").select(F.least("m", "k").alias("a"), F.greatest("m", "k").alias("b")).distinct()
    more = durable(verify(rest, docs, words, percent), "links")
    final = found if more.isEmpty() else connected_components(links.union(more))

    of_class = members.join(final, "node", "left").select("signature", F.coalesce("component", "node").alias("component_id"))
    out = sets.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "signature").join(of_class, "signature", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))
