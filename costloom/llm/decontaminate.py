"""Benchmark decontamination with one Aho-Corasick automaton over the test items' word windows.

Items and documents are lower-cased (A-Z) and cut into words of ASCII letters, digits and any
non-ASCII characters. A window is ``window`` consecutive words of an item; a shorter item with at
least one word is one window. The automaton works on word numbers, so a match gives word positions,
and a word's position gives its span in the original text.

Benchmarks are small beside the corpus, but nothing forces them to be: long items are cut into
overlapping pieces, and pieces are dealt into blocks of about ``block_words`` words. Block after
block is sent to the workers as one automaton, so the driver and a worker hold one block at a time,
and the hits of a document are carried on to the next block. One block, and so one scan of the text,
is the normal case.
"""

from __future__ import annotations

import re
import uuid
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costloom.llm.common import durable, frugal, held, refuse, text_bytes, valid_text, with_text

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = re.compile(PATTERN.encode())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class WindowMatcher:
    """The automaton of a block of (item, words) pieces."""

    def __init__(self, items: list[tuple[object, list[str]]], window: int):
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        for item, words in items:
            seq = [self.ids.setdefault(w.encode("utf-8", "surrogatepass"), len(self.ids) + 1) for w in words]
            for i in range(max(1, len(seq) - window + 1) if seq else 0):
                owners.setdefault(tuple(seq[i : i + window]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for seq, found in owners.items():
            self.automaton.add_word(seq, (len(seq), found))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners
        self.shortest = min(map(len, owners), default=1)

    def match(self, words: list[bytes]) -> list[tuple[int, int, set]]:
        """(first word, last word, items) of every occurrence of a window."""
        if self.empty or len(words) < self.shortest:
            return []
        seq = tuple(map(self.ids.get, words, repeat(0)))
        return [(end - n + 1, end, items) for end, (n, items) in self.automaton.iter(seq)]


def merge(hits: list[tuple[int, int, set]]) -> tuple[list[tuple[int, int]], set]:
    """Disjoint word ranges covered by the hits, in order, and all their items."""
    ranges: list[tuple[int, int]] = []
    items: set = set()
    for a, b, found in sorted(hits, key=lambda h: h[:2]):
        items |= found
        if ranges and a <= ranges[-1][1] + 1:
            ranges[-1] = (ranges[-1][0], max(b, ranges[-1][1]))
        else:
            ranges.append((a, b))
    return ranges, items


def item_pieces(benchmark: DataFrame, window: int, piece_windows: int = 20_000) -> DataFrame:
    """(item_id, words) with at most ``piece_windows`` windows a row; each window of an item is in one of its rows."""
    lowered = F.translate(valid_text(F.col("text")), UPPER, LOWER)
    words = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", F.regexp_extract_all(lowered, F.lit(PATTERN), 0).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - window, F.lit(0))
    starts = words.withColumn("start", F.explode(F.sequence(F.lit(0), last, F.lit(piece_windows))))
    return starts.select("item_id", F.slice("words", F.col("start") + 1, F.lit(piece_windows + window - 1)).alias("words"))


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, carry: list[str], window: int = 10, block_words: int = 250_000) -> DataFrame:
    """``carry`` columns plus ``n_words``, ``n_hit``, ``items`` and ``spans`` for every row of ``docs``.

    ``items`` are the item_ids with an occurring window, sorted as text; ``spans`` are the covered
    stretches as (start, stop) code points of the original text. Null and empty texts have no words;
    null item_ids and items without words never match; equal windows of several items count for all
    of them. Repeated rows are treated alike, empty tables give no rows or no hits. Bytes that aren't UTF-8 are
    read as U+FFFD. Carried columns may not be called ``n_words``, ``n_hit``, ``items`` or ``spans`` (ValueError).
    """
    refuse(carry, ["n_words", "n_hit", "items", "spans"])
    pieces = item_pieces(benchmark, window)
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_words))
    rows_in, at = with_text(docs, carry)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows_in.schema.fields)
    wide = rows_in.columns
    state = [*wide, "__ranges", "__items"]
    rows = rows_in
    for block in range(blocks):
        # about block_words words of the benchmark at a time
        part = pieces.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == block) if blocks > 1 else pieces
        shared = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["words"]) for r in part.collect()])
        scanned = scanner(shared, uuid.uuid4().hex, at, len(wide), window, block > 0, state)
        rows = rows.mapInArrow(frugal(scanned), f"{fields}, __ranges array<struct<a:int,b:int>>, __items array<string>")
        if block < blocks - 1:
            rows = durable(rows, "decontamination")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema.fields), "n_words long, n_hit long, items array<string>, spans array<struct<start:long,stop:long>>"])

    def finish(batches):
        for batch in batches:
            n_words, n_hit, spans = [], [], []
            ranges = batch.column(len(wide)).to_pylist()
            for value, own in zip(batch.column(at), ranges):
                data = text_bytes(value.as_py())
                if not own:
                    n_words.append(len(WORD.findall(data)))
                    n_hit.append(0)
                    spans.append([])
                    continue
                span = [m.span() for m in WORD.finditer(data)]
                n_words.append(len(span))
                n_hit.append(sum(r["b"] - r["a"] + 1 for r in own))
                spans.append([{"start": len(data[: span[r["a"]][0]].decode()), "stop": len(data[: span[r["b"]][1]].decode())} for r in own])
            tail = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), batch.column(len(wide) + 1), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), *tail], [*carry, "n_words", "n_hit", "items", "spans"])

    if blocks == 1:
        # both steps in one pass
        return rows_in.mapInArrow(frugal(lambda batches: finish(scanned(batches))), schema)
    return rows.mapInArrow(frugal(finish), schema)


def scanner(shared, key: str, at: int, width: int, window: int, later: bool, names: list[str]):
    """The scan of texts for one block; with ``later`` the hits of earlier blocks are merged in."""

    def scan(batches):
        matcher = held(key, lambda: WindowMatcher(shared.value, window))
        for batch in batches:
            ranges, items = [], []
            old = zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()) if later else repeat(([], []))
            for value, (before, known) in zip(batch.column(at), old):
                hits = matcher.match(WORD.findall(text_bytes(value.as_py())))
                own, found = merge([*hits, *((r["a"], r["b"], set()) for r in before)])
                ranges.append([{"a": a, "b": b} for a, b in own])
                items.append(sorted({*map(str, found), *known}))
            tail = [pa.array(ranges, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(width)), *tail], names)

    return scan
