"""Ranked lexical search: the best documents for each query, by groups of equal presence masks.

Queries are few beside the documents and are taken in blocks of a bounded number of terms. One scan
of the texts keeps, for each document, its length and the counts of the block's terms. The second
step works on bounded blocks of documents: every term has a bitmap of the documents that hold it; the
bitmaps of a query's terms are turned into one mask of matched terms a document, and documents with
the same mask form a group. A mask's highest possible score is the sum of its terms' largest impacts in
the block. Masks are evaluated in descending order of it, until it falls below the lowest of the best
scores found so far; only documents of evaluated masks get scores. Every task hands on its best few, and
their best are the result. All scores are integers, so the bound is safe.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costloom.llm.common import durable, frugal, held, small_batches, valid_text

#: Terms (fixed pattern): runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = re.compile(PATTERN.encode())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NONE = -1


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's integer impact in a document; ``m`` is the document's length norm in percent."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(n_docs: int, df: int) -> int:
    """A term's integer weight."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def postings(docs: DataFrame, key: str, terms: list[bytes], carry_all: bool) -> DataFrame:
    """(key, n, terms, counts): a document's number of terms, and the numbers and counts of the wanted terms in it.

    Documents without a wanted term are left out unless ``carry_all``; those without any term always are.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(terms)
    kind, name = docs.schema[key].dataType.simpleString(), uuid.uuid4().hex

    def run(batches):
        number = held(name, lambda: {t: k for k, t in enumerate(shared.value)})
        for batch in batches:
            at, lengths, flat, counts, ends = [], [], [], [], [0]
            for k, value in enumerate(batch.column(1)):
                found = TERM.findall((value.as_py() or b"").lower())
                if not found:
                    continue
                own = np.fromiter((number.get(w, NONE) for w in found), np.int64, len(found))
                ids, n = np.unique(own[own >= 0], return_counts=True)
                if len(ids) or carry_all:
                    at.append(k)
                    lengths.append(len(found))
                    flat.append(ids)
                    counts.append(n)
                    ends.append(ends[-1] + len(ids))
            if at:
                offsets = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int32())) for x in (flat, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(lengths, pa.int64()), *lists], ["key", "n", "terms", "counts"])

    rows = docs.select(F.col(key).alias("key"), valid_text(F.col("text")).cast("binary").alias("text"))
    return rows.mapInArrow(frugal(run), f"key {kind}, n long, terms array<int>, counts array<int>")


class Query:
    """One query: its distinct terms with weight times repeats."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray):
        held = weights > 0
        self.terms, self.weights = terms[held], weights[held]


class Block:
    """A block of documents: counts by document, and a bitmap of documents for each term."""

    def __init__(self, lengths: np.ndarray, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray, n_docs: int, n_terms: int, wanted: int):
        self.size, self.ends, self.terms = len(lengths), ends, terms
        self.doc = np.repeat(np.arange(self.size), np.diff(ends))
        m = 75 + (25 * lengths * n_docs) // max(1, n_terms)
        self.impacts = impact(counts.astype(np.int64), m[self.doc])
        self.local = np.full(wanted, NONE, np.int64)
        have = np.unique(terms)
        self.local[have] = np.arange(len(have))
        row = self.local[terms]
        here = np.zeros((len(have), self.size), bool)
        here[row, self.doc] = True
        self.bitmaps = np.packbits(here, axis=1)
        self.most = np.zeros(len(have), np.int64)
        np.maximum.at(self.most, row, self.impacts)

    def masks(self, query: Query) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct presence masks (rows of booleans over ``query``'s terms in the block), documents in the order of their mask, and the masks' ends."""
        rows = self.local[query.terms]
        self.here, rows = np.flatnonzero(rows >= 0), rows[rows >= 0]
        any_of = np.bitwise_or.reduce(self.bitmaps[rows], axis=0) if len(rows) else np.zeros(0, np.uint8)
        docs = np.flatnonzero(np.unpackbits(any_of, count=self.size)) if len(rows) else np.zeros(0, np.int64)
        if not len(docs):
            return np.zeros((0, len(rows)), bool), docs, np.zeros(1, np.int64)
        bits = np.unpackbits(self.bitmaps[rows], axis=1, count=self.size)[:, docs]
        keys = np.ascontiguousarray(np.packbits(bits, axis=0).T)
        width = -(-keys.shape[1] // 8) * 8
        words = np.zeros((len(docs), width), np.uint8)
        words[:, : keys.shape[1]] = keys
        words = words.view(">u8").astype(np.uint64)
        order = np.lexsort(words.T[::-1]) if words.shape[1] > 1 else np.argsort(words[:, 0], kind="stable")
        ordered = words[order]
        head = np.flatnonzero(np.any(ordered[1:] != ordered[:-1], axis=1)) + 1
        first = np.concatenate([[0], head])
        return bits[:, order[first]].T.astype(bool), docs[order], np.append(first, len(docs))

    def scores(self, docs: np.ndarray, per_term: np.ndarray) -> np.ndarray:
        """Exact scores of documents; ``per_term`` holds the query's weights, 0 for other terms."""
        lo, n = self.ends[docs], self.ends[docs + 1] - self.ends[docs]
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        # every document here matches a term, so no run is empty
        return np.add.reduceat(per_term[self.terms[at]] * self.impacts[at], np.cumsum(n) - n)

    def best(self, query: Query, per_term: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may be among the ``k`` best of all, their scores, and how many were scored; ``least`` is a score that ``k`` others have."""
        masks, docs, ends = self.masks(query)
        bound = masks @ (query.weights[self.here] * self.most[self.local[query.terms[self.here]]]) if len(docs) else np.zeros(0, np.int64)
        order = np.argsort(-bound, kind="stable")
        found, values, scored, step, at = [], [], 0, 4 * k, 0
        while at < len(order) and bound[order[at]] >= max(1, least):
            take, size = [], 0
            while at < len(order) and size < step and bound[order[at]] >= max(1, least):
                g = order[at]
                take.append(docs[ends[g] : ends[g + 1]])
                size += len(take[-1])
                at += 1
            part = np.concatenate(take)
            s = self.scores(part, per_term)
            scored += len(part)
            found.append(part[s >= max(1, least)])
            values.append(s[s >= max(1, least)])
            so_far = np.concatenate(values)
            if len(so_far) >= k:
                least = max(least, int(np.partition(so_far, len(so_far) - k)[len(so_far) - k]))
            step *= 2
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), scored
        found, values = np.concatenate(found), np.concatenate(values)
        kept = values >= least
        return found[kept], values[kept], scored


def top(keys: list, values: list, k: int) -> list[int]:
    """Positions of the ``k`` best: highest value first, then the smallest key, null keys last."""
    return sorted(range(len(keys)), key=lambda i: (-values[i], keys[i] is None, 0 if keys[i] is None else keys[i]))[:k]


def block_rows(wanted: int, cells: int = 48_000_000) -> int:
    """Documents of a block: its terms x documents bits have a bounded size."""
    return max(256, min(16_384, cells // max(1, wanted)))


def ranked(found: DataFrame, queries: list[tuple], weights: list[int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, key, score) of :func:`postings`' rows: the ``k`` best of every task."""
    spark = found.sparkSession
    shared = spark.sparkContext.broadcast((queries, np.array(weights, np.int64)))
    kind = found.schema["key"].dataType.simpleString()
    rows = block_rows(len(weights))

    def run(batches):
        asked, w = shared.value
        queries = [Query(np.array(t, np.int64), w[t] * np.array(n, np.int64)) for t, n in asked]
        best: list[tuple[list, list]] = [([], []) for _ in queries]
        per_term = np.zeros(len(w), np.int64)

        def search(held):
            keys = pa.concat_arrays([h[0] for h in held]).to_pylist()
            lengths = np.concatenate([h[1] for h in held])
            sizes = np.concatenate([np.diff(h[2]) for h in held])
            block = Block(lengths, np.concatenate([[0], np.cumsum(sizes)]), *(np.concatenate([h[c] for h in held]).astype(np.int64) for c in (3, 4)), n_docs, n_terms, len(w))
            for q, query in enumerate(queries):
                own_keys, own = best[q]
                per_term[query.terms] = query.weights
                docs, scores, _ = block.best(query, per_term, k, own[k - 1] if len(own) >= k else 1)
                per_term[query.terms] = 0
                if len(docs):
                    all_keys, values = [*own_keys, *(keys[d] for d in docs.tolist())], [*own, *scores.tolist()]
                    kept = top(all_keys, values, k)
                    best[q] = [all_keys[i] for i in kept], [values[i] for i in kept]

        held, size, bulk = [], 0, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                terms, counts = part.column(2), part.column(3)
                held.append((part.column(0), part.column(1).to_numpy(), terms.offsets.to_numpy() - terms.offsets[0].as_py(), terms.flatten().to_numpy(), counts.flatten().to_numpy()))
                size, bulk = size + part.num_rows, bulk + len(held[-1][3])
                if size >= rows or bulk > 3_000_000:
                    search(held)
                    held, size, bulk = [], 0, 0
        if held:
            search(held)
        for q, (keys, values) in enumerate(best):
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(keys), pa.int32()), pa.array(keys, batch.schema.field(0).type), pa.array(values, pa.int64())], ["query", "key", "score"])

    return found.mapInArrow(frugal(run), f"query int, key {kind}, score long")


def first_of(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    """The ``k`` best rows a group, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", k: int = 20, block_terms: int = 100_000) -> DataFrame:
    """(item, rank, key, score): the ``k`` best documents of each item, with a score above 0.

    ``docs`` has the key and ``text``, ``items`` the item and ``text``. Null texts have no terms. Items
    with a null id are left out; distinct texts of one id are one query; repeated item rows count once.
    Every row of ``docs`` is a document of its own, counted and ranked, also if it repeats; equal scores
    go by ascending key, null keys last. Terms that no document holds add nothing. Bytes that aren't UTF-8
    count as U+FFFD. Empty tables give no rows; other columns are ignored. Items are taken in blocks of about
    ``block_terms`` terms, one scan of the texts each; a block's terms and queries are all that is broadcast.
    """
    small_batches(docs.sparkSession)
    found = F.regexp_extract_all(F.translate(valid_text(F.col("text")), UPPER, LOWER), F.lit(PATTERN), 0)
    asked = items.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), "text").distinct().select("item", F.explode(found).alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("n"))
    asked = durable(asked, "search-terms")
    total = asked.count()
    blocks = max(1, -(-total // block_terms))
    out, n_docs, n_terms = None, None, None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else asked
        rows = part.collect()  # about block_terms rows
        terms = sorted({r["term"] for r in rows})
        number = {t: i for i, t in enumerate(terms)}
        queries: dict = {}
        for r in rows:
            queries.setdefault(r["item"], []).append((number[r["term"]], r["n"]))
        held_docs = durable(postings(docs, key, [t.encode() for t in terms], n_docs is None), "search-postings")
        if n_docs is None:
            size = held_docs.agg(F.count(F.lit(1)), F.sum("n")).first()
            n_docs, n_terms = int(size[0]), int(size[1] or 0)
        df = dict(held_docs.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # one row a term of the block
        weights = [weight(n_docs, df.get(i, 0)) for i in range(len(terms))]
        ids = list(queries)
        # a task's best, the best of a few tasks, the best of all
        parts = ranked(held_docs, [([t for t, _ in queries[i]], [n for _, n in queries[i]]) for i in ids], weights, n_docs, n_terms, k)
        some = first_of(parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64))), k, "query", "part").drop("rank")
        names = docs.sparkSession.createDataFrame(list(enumerate(ids)), f"query int, `{item}` {items.schema[item].dataType.simpleString()}")
        done = first_of(some, k, "query").join(F.broadcast(names), "query").select(item, "rank", F.col("key").alias(key), "score")
        out = done if out is None else out.union(done)
    return out
