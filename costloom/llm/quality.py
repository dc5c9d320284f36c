"""Quality classifier: hashed word n-gram logistic regression, fitted with follow-the-regularised-leader.

Features of a text are its distinct word n-grams (n = 1, 2) hashed into ``2 ** bits`` slots, each
with the weight 1 / sqrt(number of features). Words are runs of letters or digits, or single other
characters, of the A-Z lower-cased text. The model is fitted on a bounded, hash-picked sample of
the labelled rows (``max_rows``); every text is scored whole as a sparse dot product.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costloom.llm.common import durable, frugal, mix64, refuse, small_batches, text_slices, token_hashes, valid_text, with_text

#: Words of letters, digits and non-ASCII bytes; any other byte that is not blank is a token of its own.
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xFF]+|[^\x20\x09-\x0D]")
#: The length of a text's feature vector, without the intercept.
SCALE = 4.0


def features(texts: list, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of the distinct hashed word n-grams, sorted; slot 0 is the intercept, in every text."""
    h, owner = token_hashes(texts, TOKEN)
    slots = h >> np.uint64(64 - bits)
    same = owner[1:] == owner[:-1]
    pairs = mix64(h[:-1] * np.uint64(3) + h[1:])[same] >> np.uint64(64 - bits)
    n = np.arange(len(texts))
    keys = np.unique(np.concatenate([n << bits, owner << bits | slots.astype(np.int64), owner[1:][same] << bits | pairs.astype(np.int64)]))
    return keys >> bits, keys & ((1 << bits) - 1)


def fit_ftrl(rows, bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights after ``epochs`` passes of FTRL-proximal over (slots, label) rows in the given order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(zs, ns):
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for slots, label, value in rows:
            zs, ns = z[slots], n[slots]
            w = weights(zs, ns)
            p = 1 / (1 + np.exp(-np.clip(w.dot(value), -30, 30)))
            g = (p - label) * value
            sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha
            z[slots] = zs + g - sigma * w
            n[slots] = ns + g * g
    return weights(z, n).astype(np.float32)


def valued(slots: np.ndarray) -> np.ndarray:
    """Feature values: 1 for the intercept, else 1 / sqrt(number of features)."""
    value = np.full(len(slots), SCALE / np.sqrt(len(slots)))
    value[0] = 1.0
    return value


def train(docs: DataFrame, labels: DataFrame, bits: int = 18, max_rows: int = 12_000, epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.1, l2: float = 0.05, max_slots: int = 60_000_000) -> np.ndarray:
    """Fit on the documents of about ``max_rows`` rows of ``labels`` (doc_id, label 0/1), picked by a hash.

    The picked labels are at most about ``max_rows`` narrow rows, so they are broadcast and the texts
    stay where they are. Null texts count as empty. Without rows all weights are 0, so that every
    text scores 0.5. Repeated texts of one label count once, and so do repeated labels. If the picked texts have more
    than ``max_slots`` features (4 bytes each) together, a part of them that has about as many is taken, by their hash.
    """
    small_batches(docs.sparkSession)
    labels = labels.distinct()
    total = labels.count()
    cut = 2.0**64 * min(1.0, max_rows / max(1, total)) - 2.0**63
    chosen = labels.where(F.xxhash64("doc_id").cast("double") <= cut)
    picked = docs.join(F.broadcast(chosen), "doc_id").select(F.coalesce(valid_text(F.col("text")), F.lit("")).alias("text"), "label").withColumn("h", F.xxhash64("text"))

    def slots(batches):
        for batch in batches:
            found = []
            for _, _, column in text_slices(batch.column(0), 1_000_000):
                owner, slot = features(column.cast(pa.binary()).to_pylist(), bits)
                found += [s.astype(np.int32).tobytes() for s in np.split(slot, np.flatnonzero(np.diff(owner)) + 1)]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1).cast(pa.int32()), pa.array(found, pa.binary())], ["h", "label", "slots"])

    sparse = durable(picked.mapInArrow(frugal(slots), "h long, label int, slots binary").dropDuplicates(["h", "label"]), "sparse-labels")
    size = (sparse.agg(F.sum(F.octet_length("slots"))).first()[0] or 0) / 4
    if size > max_slots:
        sparse = sparse.where(F.xxhash64("h").cast("double") <= 2.0**64 * (max_slots / size) - 2.0**63)

    def fit(data):
        data = data.sort_by([("h", "ascending"), ("label", "ascending")])
        rows = [(np.frombuffer(s, np.int32), y) for s, y in zip(data["slots"].to_pylist(), data["label"].to_pylist())]
        w = fit_ftrl([(s, y, valued(s)) for s, y in rows], bits, epochs, alpha, beta, l1, l2)
        return pa.table({"w": pa.array([zlib.compress(w.tobytes(), 1)], pa.binary())})

    # one model, and so one group: at most about max_rows sparse rows of max_slots features together
    model = sparse.groupBy(F.lit(0).alias("model")).applyInArrow(fit, "w binary").collect()
    return np.frombuffer(zlib.decompress(model[0]["w"]), np.float32) if model else np.zeros(1 << bits, np.float32)


def score(docs: DataFrame, weights: np.ndarray, carry: list[str]) -> DataFrame:
    """``carry`` columns plus ``score`` (0 to 1, higher: label 1 likelier) for every row of ``docs``.

    Null and empty texts score as the intercept alone; repeated rows score alike; an empty table
    gives an empty result; other columns are ignored unless carried. Bytes that aren't UTF-8 are read as U+FFFD.
    Carried columns may not be called ``score`` (ValueError).
    """
    refuse(carry, ["score"])
    bits = len(weights).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows, at = with_text(docs, carry)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema.fields), "score double"])

    def run(batches):
        w = shared.value
        for batch in batches:
            out = []
            for _, _, column in text_slices(batch.column(at), 1_000_000):
                owner, slot = features(column.cast(pa.binary()).to_pylist(), bits)
                size = np.bincount(owner)
                total = np.bincount(owner, np.where(slot > 0, w[slot], 0.0)) * SCALE / np.sqrt(size) + w[0]
                out.append(1 / (1 + np.exp(-np.clip(total, -30, 30))))
            out = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), pa.array(out)], [*carry, "score"])

    return rows.mapInArrow(frugal(run), schema)


def classify(docs: DataFrame, labels: DataFrame, learn: Column, carry: list[str], threshold: float = 0.7, **options) -> DataFrame:
    """Fit on the labels for which ``learn`` (over doc_id) holds, then score all of ``docs``.

    ``labels`` has doc_id and quality; several labels of one document all count. Documents with a
    null doc_id are scored and never learnt from.
    """
    known = labels.where(F.coalesce(learn, F.lit(False))).select("doc_id", F.col("quality").alias("label")).where(F.col("label").isin(0, 1))
    weights = train(docs.select("doc_id", "text"), known, **options)
    return score(docs, weights, carry).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
