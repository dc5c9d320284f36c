"""Subword lattice language model.

A text is its A-Z lower-cased white-space words and one end. A word, with a mark before it, is
spelled with the pieces of an existing SentencePiece vocabulary; a character outside it is spelled
with byte pieces. All segmentations count: the probability of a word is the sum over its
segmentations of the products of piece probabilities, by forward recursion in log space, and the
log probability of a text is the sum over its words and its end.

* Pieces that open a word form one distribution; those that go on, and the stop, form another. So
  the lattice is a distribution over words.
* A unigram vocabulary's own scores can weight the segmentations as they are (``scores="own"``).
* The public vocabulary is a merge (BPE) vocabulary, whose scores are ranks and no probabilities.
  The pieces' probabilities are learnt by expectation maximisation over the training words and
  their counts, from the vocabulary's own segmentations as the start. The vocabulary itself is left
  as it is.
* ``word_score`` is a second model beside it: each counted training word is one more arc of its
  lattice, under absolute discounting, P(word) = (count - D) / N + (D V / N) lattice(word).

Counts and scores are computed once in a table of distinct words, which is joined by hash. Documents
and the words of their block then meet in one partition: blocks hold about ``block_bytes`` of text
and there is one partition a block, so memory stays bounded at every size, and a block's distinct
words are far fewer than its tokens.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costloom.llm.common import WORD, durable, frugal, small_batches, text_bytes, valid_text
from costloom.llm.encoding import read_model
from costloom.llm.pieces import MARK, Vocabulary


class Lattice:
    """Forward and backward recursions over the segmentations of marked words.

    Words should come sorted: states of the prefix shared with the word before are kept.
    """

    #: Longer words, and words of a smaller probability, are taken in log space one by one when expectations are summed.
    LINEAR, LEAST = 40, 1e-250

    def __init__(self, vocabulary: Vocabulary, log_prob: np.ndarray, log_stop: float):
        self.v, self.log_prob, self.log_stop = vocabulary, log_prob.tolist(), log_stop
        # trie of the reversed pieces; the empty string marks a whole piece
        self.back: dict = {}
        for piece, i in vocabulary.ids.items():
            node = self.back
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = i

    def arcs(self, w: str, i: int) -> list[tuple[int, int]]:
        """(start, piece) of the pieces that end before position ``i``."""
        node, out, j = self.back, [], i
        while j:
            j -= 1
            node = node.get(w[j])
            if node is None:
                break
            if "" in node:
                out.append((j, node[""]))
        return out

    def bytes_of(self, char: str) -> list[int]:
        return self.v.bytes[list(char.encode("utf-8", "surrogatepass"))].tolist()

    def spelled(self, char: str) -> float:
        """Log probability of a character's byte pieces."""
        return sum(self.log_prob[b] for b in self.bytes_of(char))

    def step(self, forward: list, w: str, i: int) -> float:
        """Log of the summed probability of all segmentations of the first ``i`` characters."""
        total = None
        for j, p in self.arcs(w, i):
            x = forward[j] + self.log_prob[p]
            if total is None:
                total = x
            elif x > total:
                total = x + math.log1p(math.exp(total - x))
            else:
                total += math.log1p(math.exp(x - total))
        if total is None:  # no piece ends here
            total = forward[i - 1] + self.spelled(w[i - 1])
        return total

    def log_probabilities(self, words: list[str]) -> list[float]:
        """Natural logs of the lattice probabilities of words."""
        out, forward, before = [], [0.0], ""
        for word in words:
            w = MARK + word
            del forward[shared_prefix(before, w) + 1 :]
            for i in range(len(forward), len(w) + 1):
                forward.append(self.step(forward, w, i))
            out.append(forward[-1] + self.log_stop)
            before = w
        return out

    def expectations(self, words: list[str], counts: list) -> np.ndarray:
        """Expected number of each piece in the words' segmentations, each word ``count`` times.

        Adjoints of a shared prefix are summed before they go back through it, so each character of
        the words' trie is visited once each way. Words too long or too unlikely for plain numbers
        are taken in log space.
        """
        total = [0.0] * self.v.size
        fallback: list[str] = []
        prob = np.exp(np.array(self.log_prob)).tolist()
        forward, adjoint, arcs, before = [1.0], [0.0], [()], ""

        def close(k: int) -> None:
            for i in range(len(forward) - 1, k, -1):
                a = adjoint[i]
                if a:
                    for j, p in arcs[i]:
                        x = prob[p] * a
                        total[p] += forward[j] * x
                        adjoint[j] += x
            del forward[k + 1 :], adjoint[k + 1 :], arcs[k + 1 :]

        for word, n in zip(words, counts):
            w = MARK + word
            if len(w) > self.LINEAR:
                self.long_expectations(w, n, total)
                continue
            close(shared_prefix(before, w))
            before = w
            for i in range(len(forward), len(w) + 1):
                own = self.arcs(w, i)
                if own:
                    forward.append(sum([forward[j] * prob[p] for j, p in own]))
                else:
                    # no piece ends here: byte pieces, as one arc of its own
                    forward.append(forward[i - 1] * math.exp(self.spelled(w[i - 1])))
                    own = [(i - 1, len(prob))]
                    prob.append(math.exp(self.spelled(w[i - 1])))
                    total.append(0.0)
                    fallback.append(w[i - 1])
                adjoint.append(0.0)
                arcs.append(own)
            if forward[-1] > self.LEAST:
                adjoint[-1] += n / forward[-1]
            else:
                self.long_expectations(w, n, total)
        close(0)
        for char, x in zip(fallback, total[self.v.size :]):
            for b in self.bytes_of(char):
                total[b] += x
        return np.array(total[: self.v.size])

    def long_expectations(self, w: str, n: float, total: list) -> None:
        """The same for one word in log space."""
        forward = [0.0]
        for i in range(1, len(w) + 1):
            forward.append(self.step(forward, w, i))
        posterior = [0.0] * len(w) + [float(n)]
        for i in range(len(w), 0, -1):
            if posterior[i]:
                own = self.arcs(w, i)
                for j, p in own:
                    x = posterior[i] * math.exp(forward[j] + self.log_prob[p] - forward[i])
                    total[p] += x
                    posterior[j] += x
                if not own:
                    posterior[i - 1] += posterior[i]
                    for b in self.bytes_of(w[i - 1]):
                        total[b] += posterior[i]


def shared_prefix(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def decoded(words: pa.Array) -> list[str]:
    return [w.decode("utf-8", "replace") for w in words.to_pylist()]


def block_words(docs: DataFrame, words_held: int = 1_500_000) -> DataFrame:
    """(block, word, n) with n the count of the word in the block's learning rows; once per block and task, or more."""

    def run(batches):
        held: dict[int, Counter] = {}
        size = 0
        for batch in batches:
            for block, learn, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = WORD.findall(text_bytes(text))
                own = held.setdefault(block, Counter())
                before = len(own)
                if learn:
                    own.update(words)
                else:
                    for w in words:
                        if w not in own:
                            own[w] = 0
                size += len(own) - before
                if size > words_held:
                    yield from send(held)
                    held, size = {}, 0
        yield from send(held)

    def send(held):
        for block, own in held.items():
            words, counts = list(own.keys()), list(own.values())
            for lo in range(0, len(words), 100_000):
                hi = min(len(words), lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array([block] * (hi - lo), pa.int32()), pa.array(words[lo:hi], pa.binary()), pa.array(counts[lo:hi], pa.int64())], ["block", "word", "n"])

    return docs.select("block", "learn", "text").mapInArrow(frugal(run), "block int, word binary, n long")


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """(piece, n) rows summed into one array; at most one row a piece reaches the driver."""
    counted = parts.groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[counted["piece"].to_numpy()] = counted["n"].to_numpy()
    return out


def vocabulary_counts(words: DataFrame, model: bytes, size: int) -> np.ndarray:
    """How often each piece occurs in the vocabulary's own segmentations of (word, c) rows."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        sp = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        total = np.zeros(size)
        for batch in batches:
            ids = sp.encode(decoded(batch.column(0)), num_threads=1)
            times = np.repeat(batch.column(1).to_numpy(), [len(x) for x in ids])
            total += np.bincount(np.fromiter(chain.from_iterable(ids), np.int64), times, size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["piece", "n"])

    return summed(words.select("word", "c").mapInArrow(frugal(run), "piece int, n double"), size)


def expected_counts(words: DataFrame, model: bytes, probabilities: tuple, size: int) -> np.ndarray:
    """One expectation step over (word, c) rows."""
    shared = words.sparkSession.sparkContext.broadcast((model, *probabilities))

    def run(batches):
        model, log_prob, log_stop = shared.value
        lattice = Lattice(Vocabulary(model), log_prob, log_stop)
        total = np.zeros(size)
        for batch in batches:
            total += lattice.expectations(decoded(batch.column(0)), batch.column(1).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["piece", "n"])

    return summed(words.select("word", "c").mapInArrow(frugal(run), "piece int, n double"), size)


def probabilities(counts: np.ndarray, stops: int, v: Vocabulary, smooth: float) -> tuple[np.ndarray, float]:
    """Log probabilities of the pieces within their distribution, and of the stop."""
    opens = np.zeros(v.size, bool)
    opens[[i for p, i in v.ids.items() if p.startswith(MARK)]] = True
    usable = np.zeros(v.size, bool)
    usable[[*v.ids.values(), *v.bytes.tolist()]] = True
    mass = np.where(usable, counts + smooth, 0.0)
    going = mass[~opens].sum() + stops + smooth
    with np.errstate(divide="ignore"):
        log_prob = np.log(mass) - np.where(opens, math.log(mass[opens].sum() or 1.0), math.log(going))
    return np.where(usable, log_prob, -1e9), math.log((stops + smooth) / going)


def own_probabilities(v: Vocabulary) -> tuple[np.ndarray, float]:
    """A unigram vocabulary's own scores as log probabilities; byte pieces count as the worst score less 10, and a stop is certain."""
    log_prob = np.full(v.size, -1e9)
    log_prob[v.bytes[v.bytes > 0]] = v.worst
    for i, score in v.score.items():
        log_prob[i] = score
    return log_prob, 0.0


def word_scores(words: DataFrame, model: bytes, fitted: tuple, tokens: int, discount: float, rest: float, share: float) -> DataFrame:
    """(word, c, s, w): log10 probabilities of the word by the lattice, and with its whole-word arc; ``share`` is that of words among tokens."""
    shared = words.sparkSession.sparkContext.broadcast((model, *fitted))

    def run(batches):
        model, log_prob, log_stop = shared.value
        lattice = Lattice(Vocabulary(model), log_prob, log_stop)
        for batch in batches:
            spelled = np.array(lattice.log_probabilities(decoded(batch.column(0))))
            whole = np.maximum(batch.column(1).to_numpy() - discount, 0.0) / max(1, tokens)
            with np.errstate(divide="ignore"):
                w = np.logaddexp(np.log(whole), math.log(rest) + spelled) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((math.log(share) + spelled) / math.log(10)), pa.array(w)], ["word", "c", "s", "w"])

    return words.select("word", "c").mapInArrow(frugal(run), "word binary, c long, s double, w double")


def score_documents(docs: DataFrame, learn: Column, model_path: str | None = None, smooth: float = 0.1, rounds: int = 3, block_bytes: int = 24_000_000, scores: str = "learnt") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, word_score) for every row of ``docs`` (doc_id, text).

    ``learn`` says which rows may be learnt from (null: not). ``base_score`` is the additive word
    unigram model with 0.1 as the added count, ``score`` the lattice model and ``word_score`` the
    lattice model with whole-word arcs; all are log10 probabilities. With ``scores="own"`` the model is a unigram
    vocabulary whose own scores weight the segmentations: nothing is fitted, and ``score`` is the sum of the words' marginals, without an end. Null and empty texts are one end
    token. With nothing to learn from, words have no count and pieces are equally likely. Repeated
    rows all count and are scored alike; an empty table gives no rows; other columns are ignored. Bytes
    that aren't UTF-8 are read as U+FFFD.
    """
    if scores not in ("learnt", "own"):
        raise ValueError(f"no such scores: {scores}")
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(valid_text(F.col("text")), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    size = rows.agg(F.sum(F.octet_length("text") + 1), F.sum(F.col("learn").cast("long"))).first()
    blocks = max(1, math.ceil((size[0] or 0) / block_bytes))
    ends = int(size[1] or 0)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    # one block a partition, so that no task gets more text or words than a block's
    pairs = durable(block_words(rows.repartitionById(blocks, "block")), "block-words")
    words = durable(pairs.groupBy("word").agg(F.sum("n").alias("c")), "words")
    words = words.sortWithinPartitions("word")
    trained = words.where("c > 0")
    known = trained.agg(F.sum("c"), F.count(F.lit(1)), F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long"))).first()
    n_tokens, n_words, once, twice = int(known[0] or 0), int(known[1]), int(known[2] or 0), int(known[3] or 0)
    tokens, distinct = n_tokens + ends, n_words + (ends > 0)
    discount = once / (once + 2 * twice) if once else 0.5

    model = read_model(model_path)
    v = Vocabulary(model)
    if scores == "own":
        fitted = own_probabilities(v)
    else:
        fitted = probabilities(vocabulary_counts(trained, model, v.size), n_tokens, v, smooth)
        for _ in range(rounds):
            fitted = probabilities(expected_counts(trained, model, fitted, v.size), n_tokens, v, smooth)
    # without a training word all mass is the lattice's
    rest = discount * n_words / tokens if n_words else 1.0
    share = n_tokens / tokens if n_words and scores != "own" else 1.0
    scored = word_scores(words, model, fitted, tokens, discount, rest, share)
    log_end = math.log10(max(ends, 0.1) / max(tokens, 1)) if scores != "own" else 0.0
    floor = 0.1 / (tokens + 0.1 * (distinct + 1))
    ready = pairs.select("block", "word").join(scored, "word").select("block", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("string").alias("text"), "word", "c", "s", "w")
    texts = rows.select("block", "doc_id", "text", F.lit(None).cast("binary").alias("word"), F.lit(None).cast("long").alias("c"), F.lit(None).cast("double").alias("s"), F.lit(None).cast("double").alias("w"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = math.log10((ends + 0.1) * (floor / 0.1))

    def add(batches):
        at, table, place = None, {}, None
        for batch in batches:
            out = []
            block, text, word = batch.column(0).to_numpy(), batch.column(2), batch.column(3)
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for lo, hi in zip(edges, edges[1:]):
                if at != block[lo]:
                    at, table, held = block[lo], {}, []
                spelled = word.slice(lo, hi - lo)
                # a block's words come before its texts
                split = lo + (hi - lo) - spelled.null_count
                if split > lo:
                    base = sum(map(len, (h[0] for h in held)))
                    table.update(zip(word.slice(lo, split - lo).to_pylist(), range(base, base + split - lo)))
                    held.append(tuple(batch.column(c).slice(lo, split - lo).to_numpy() for c in (4, 5, 6)))
                if split == hi:
                    continue
                if len(held) > 1:
                    held = [tuple(map(np.concatenate, zip(*held)))]
                place = table.__getitem__
                for k, t in enumerate(text.slice(split, hi - split).cast(pa.binary()).to_pylist(), split):
                    found = WORD.findall(t.lower())
                    ids = np.fromiter(map(place, found), np.int64, len(found))
                    counts, s, w = (x[ids] for x in held[0]) if len(ids) else (np.zeros(0),) * 3
                    out.append((k, len(ids) + 1, int((counts > 0).sum()) + (ends > 0), float(np.log10((counts + 0.1) * (floor / 0.1)).sum()) + end, float(s.sum()) + log_end, float(w.sum()) + log_end))
            if out:
                at_rows, n, k, base_score, lattice, mixed = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at_rows, pa.int64())), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array([tokens] * len(n), pa.int64()), pa.array(base_score), pa.array(lattice), pa.array(mixed)], names)

    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "word_score"]
    shape = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, word_score double"
    ordered = ready.union(texts).repartitionById(blocks, "block").sortWithinPartitions("block", F.col("word").isNull())
    return ordered.mapInArrow(frugal(add), shape)
