"""Language identification by cross-parsing.

A bounded sample of labelled text per language is indexed in a suffix automaton.
A text is cut greedily into the longest phrases that occur in a language's sample;
the language that needs the fewest bits (phrases times the log of the sample length,
per character) wins.

Bounds, all parameters: ``sample_chars`` characters of training text per language, drawn evenly from
``sample_docs`` distinct texts picked by a hash of their text. All languages are learnt, and every letter
of the samples counts, unless ``max_langs`` says otherwise: the ``alphabet`` most frequent letters have a symbol each, the
others a pair of symbols, so that the automata's tables stay narrow for large scripts too. All texts are parsed whole.

Texts are parsed in pieces side by side. A phrase runs on from piece to piece: the start of each
piece is parsed again from the state in which its predecessor ended, until both parses meet.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costloom.llm.common import frugal, held, refuse, text_slices, valid_text, with_text

#: Codes of spaces and of letters that no sample has; each of the last is a phrase of its own.
SPACE, UNSEEN = 0, 1
#: Long texts are parsed in pieces of this many characters; results don't depend on it.
PIECE = 1024
SCHEMA_TAIL = "lang_pred string, score double, bits_per_char double"


def level(lengths: list[int], room: int) -> int:
    """The largest length that texts can be cut to so that all together, with a space each, fit into ``room``."""
    out = 0
    for k, n in enumerate(sorted(lengths)):
        out = max(0, room // (len(lengths) - k) - 1)
        if n > out:
            return out
        room -= n + 1
    return max([out, *lengths])


def training_sample(docs: DataFrame, learn: Column, sample_docs: int, sample_chars: int, max_langs: int | None = None) -> dict[str, str]:
    """Text per language, at most ``sample_chars`` characters, from the ``sample_docs`` distinct texts with the smallest hashes.

    All languages have one, or the ``max_langs`` with the most distinct texts.

    Each picked text gives the same number of characters, from an offset that its hash chooses; what short
    texts leave over goes to the longer ones, up to four times an equal share.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", F.xxhash64("text").alias("h"))
    largest = rows.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang")
    largest = largest if max_langs is None else largest.limit(max_langs)
    counts = {r["lang"]: r["n"] for r in largest.collect()}
    if not counts:
        return {}
    # a hash range that holds sample_docs distinct texts of each language, by six standard deviations
    wanted = sample_docs + 6 * math.sqrt(sample_docs) + 18
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, wanted / n))])
    parts = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, 4 * math.ceil(sample_chars / min(n, sample_docs)))])
    cut = (share[F.col("lang")] * 2.0**64) - 2.0**63
    picked = rows.where(F.col("lang").isin(list(counts)) & (F.col("h").cast("double") <= cut)).withColumn("part", parts[F.col("lang")])
    offset = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - F.col("part") + 1, F.lit(1))).cast("int")
    picked = picked.withColumn("text", F.substring("text", offset + 1, F.col("part"))).dropDuplicates(["lang", "h"])
    texts: dict[str, list[str]] = {}
    for r in sorted(picked.select("lang", "h", "text").collect(), key=lambda r: (r["lang"], r["h"])):
        own = texts.setdefault(r["lang"], [])
        if len(own) < sample_docs:
            own.append(r["text"])
    out: dict[str, str] = {}
    for lang, own in texts.items():
        part = level([len(t) for t in own], sample_chars)
        out[lang] = " ".join(t[:part] for t in own)[:sample_chars]
    return out


def automaton(codes: list[int], width: int) -> list[list[int]]:
    """Transition rows of the suffix automaton of a code sequence; 0 stands for no transition."""
    rows, link, length, last = [[0] * width], [-1], [0], 0
    for c in codes:
        cur = len(rows)
        rows.append([0] * width)
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and not rows[p][c]:
            rows[p][c] = cur
            p = link[p]
        if p != -1:
            q = rows[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(rows)
                rows.append(list(rows[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and rows[p][c] == q:
                    rows[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return rows


class CrossParser:
    """The automata of all languages in one table; parses batches of texts in lockstep."""

    def __init__(self, sample: dict[str, str], alphabet: int = 62, piece: int = PIECE, score_chars: int = 64):
        self.langs, self.piece, self.score_chars = sorted(sample), piece, score_chars
        seen: dict[str, int] = {}
        for lang in self.langs:
            for ch in sample[lang].lower():
                if ch.isalpha():
                    seen[ch] = seen.get(ch, 0) + 1
        ranked = sorted(seen, key=lambda ch: (-seen[ch], ch))
        letters, rare = ranked[:alphabet], ranked[alphabet:]
        # a rare letter is spelled by one of ``half`` first and one of ``half`` second symbols
        self.half = math.isqrt(max(0, len(rare) - 1)) + 1 if rare else 0
        self.pairs = len(letters) + 2
        self.width = self.pairs + 2 * self.half
        limit = 1 + max([0x250, *map(ord, ranked)])
        self.map = np.full(limit + 1, SPACE, np.int32)
        for cp in range(limit):
            if chr(cp).isalpha():
                self.map[cp] = UNSEEN
        for k, ch in enumerate(letters):
            self.map[ord(ch)] = k + 2
        for k, ch in enumerate(rare):
            self.map[ord(ch)] = self.width + k
        self.limit = limit
        tables, self.start, at = [], [], 0
        self.log_len = np.empty(len(self.langs))
        for k, lang in enumerate(self.langs):
            codes = self.codes(sample[lang])[0]
            # every symbol once, so that a phrase is never empty
            t = np.array(automaton([UNSEEN, *(c for c in range(self.width) if c != UNSEEN), *codes.tolist()], self.width), np.int64)
            miss = t == 0
            t = np.where(miss, t[0], t) + at
            tables.append((t * self.width) << 1 | miss)
            self.start.append(at * self.width)
            self.log_len[k] = math.log2(len(codes) + self.width)
            at += len(t)
        # 32 bits while they are enough
        kind = np.int32 if (at * self.width) << 1 < 2**31 else np.int64
        self.table = np.concatenate([t.astype(kind) for t in tables]).ravel() if tables else np.zeros(1, np.int32)

    def codes(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Codes of lower-cased text with runs of non-letters as one space; and how many codes each character gives."""
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        wide = cps >= self.limit
        codes = self.map[np.minimum(cps, self.limit)]
        if wide.any():  # letters of other scripts
            at = np.flatnonzero(wide)
            codes[at] = [UNSEEN if chr(c).isalpha() else SPACE for c in cps[at].tolist()]
        keep = np.ones(len(codes), np.int8)
        keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
        codes = codes[keep > 0]
        rare = codes >= self.width
        if rare.any():
            keep[keep > 0] += rare
            size = 1 + rare
            first = np.cumsum(size) - size
            spelled = np.repeat(codes, size)
            k = codes[rare] - self.width
            spelled[first[rare]] = self.pairs + k // self.half
            spelled[first[rare] + 1] = self.pairs + self.half + k % self.half
            codes = spelled
        return codes, keep

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases per text and language, characters and letters per text."""
        lowered = [t.lower() for t in texts]
        ends = np.cumsum([len(t) + 1 for t in lowered])
        codes, keep = self.codes("".join(f"{t}\n" for t in lowered))
        stop = np.cumsum(keep)[ends - 1]
        begin = np.concatenate([[0], stop[:-1]])
        # a text's first space may have been taken up by its predecessor's last one
        n = stop - begin
        letters = np.concatenate([[0], np.cumsum(codes != SPACE)])
        letters = letters[stop] - letters[begin]
        count = np.maximum(1, -(-n // self.piece))
        owner = np.repeat(np.arange(len(texts)), count)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        at = begin[owner] + piece * self.piece
        size = np.minimum(stop[owner] - at, self.piece)
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        k = len(self.langs)
        fresh = np.array(self.start, self.table.dtype)
        missed, state = self.walk(codes, at[order], size[order], np.repeat(fresh[:, None], len(owner), 1))
        missed, state = missed[:, place], state[:, place]
        later = np.flatnonzero(piece > 0)
        # the state that a piece should have begun in is the one its predecessor ended in
        extra, met = self.rejoin(codes, at[later], size[later], state[:, later - 1])
        missed[:, later] += extra
        out = np.zeros((k, len(texts)))
        for j in range(k):
            out[j] = np.bincount(owner, missed[j], len(texts)) + (n > 0)
        for j, i in {(j, int(owner[later[x]])) for j, x in zip(*np.nonzero(~met))}:
            # a parse that met its other one nowhere in a piece: that text anew, in one go
            out[j, i] = 1 + self.alone(codes[begin[i] : stop[i]].tolist(), j)
        return out, n, letters

    def walk(self, codes, at, size, state) -> tuple[np.ndarray, np.ndarray]:
        """Ended phrases and last states of pieces (longest first) from the given states, all languages side by side."""
        missed = np.zeros(state.shape, np.int32)
        active = np.searchsorted(-size, -np.arange(1, self.piece + 1), side="right")
        for t in range(int(size[0]) if len(size) else 0):
            m = active[t]
            v = self.table[state[:, :m] + codes[at[:m] + t]]
            missed[:, :m] += v & 1
            state[:, :m] = v >> 1
        return missed, state

    def rejoin(self, codes, at, size, state) -> tuple[np.ndarray, np.ndarray]:
        """How many phrases more end in pieces begun in ``state`` than in those begun anew, and whether both parses met."""
        k, m = state.shape
        extra, met = np.zeros(k * m, np.int32), np.zeros(k * m, bool)
        own, other = state.ravel().copy(), np.repeat(np.array(self.start, self.table.dtype), m)
        left = np.flatnonzero(own != other)
        met[own == other] = True
        t = 0
        while len(left):
            left = left[size[left % m] > t]
            code = codes[at[left % m] + t]
            a, b = self.table[own[left] + code], self.table[other[left] + code]
            extra[left] += (a & 1) - (b & 1)
            own[left], other[left] = a >> 1, b >> 1
            same = (a >> 1) == (b >> 1)
            met[left[same]] = True
            left = left[~same]
            t += 1
        return extra.reshape(k, m), met.reshape(k, m)

    def alone(self, codes: list[int], lang: int) -> int:
        """Ended phrases of one text in one language."""
        state, missed, table = self.start[lang], 0, self.table
        for c in codes:
            v = int(table[state + c])
            missed += v & 1
            state = v >> 1
        return missed

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, confidence and bits per character of each text."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        found, n, letters = self.phrases(texts)
        bits = found * self.log_len[:, None] / np.maximum(n, 1)
        best = bits.argmin(0)
        low = bits.min(0)
        odds = np.exp2(-(bits - low) * np.minimum(n, self.score_chars)).sum(0)
        score = np.where(letters > 0, 1 / odds, 0.0)
        return [self.langs[b] if x else "und" for b, x in zip(best, letters)], score, np.where(letters > 0, low, 0.0)


def identify(
    docs: DataFrame,
    learn: Column,
    carry: list[str],
    sample_docs: int = 400,
    sample_chars: int = 16_000,
    alphabet: int = 62,
    max_langs: int | None = None,
    score_chars: int = 64,
) -> DataFrame:
    """``carry`` columns plus ``lang_pred``, ``score`` and ``bits_per_char`` for every row of ``docs``.

    ``docs`` needs ``text`` and ``lang``; ``learn`` says which rows may be learnt from (null: not).
    Null texts and texts without a letter get ``und`` and a score of 0; so does everything when no
    row can be learnt from. ``score`` is the posterior of the language under equal priors, counting
    the evidence of at most ``score_chars`` characters, as phrases aren't independent. Ties go to the first language by name. Repeated rows are scored alike;
    an empty table gives an empty result. Bytes that aren't UTF-8 are read as U+FFFD. Other columns are ignored
    unless carried; carried columns may not bear a result's name (ValueError).
    """
    refuse(carry, ["lang_pred", "score", "bits_per_char"])
    docs = docs.withColumn("text", valid_text(F.col("text")))
    sample = training_sample(docs, F.coalesce(learn, F.lit(False)), sample_docs, sample_chars, max_langs)
    rows, at = with_text(docs, carry)
    fields = [f for f in docs.select(*carry).schema.fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), SCHEMA_TAIL])
    key = ("languages", tuple(sorted(sample.items())), alphabet, score_chars)

    def score(batches):
        parser = held(key, lambda: CrossParser(sample, alphabet, score_chars=score_chars))
        for batch in batches:
            for lo, hi, column in text_slices(batch.column(at), 1_500_000):
                lang, conf, bits = parser.predict([t or "" for t in column.to_pylist()])
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(conf), pa.array(bits)], [*carry, "lang_pred", "score", "bits_per_char"])

    return rows.mapInArrow(frugal(score), schema)
