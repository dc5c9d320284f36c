"""Fill-in-middle transformation on piece tables.

A document is a list of descriptors (buffer, start, stop) over buffers that never change: the text and
the sentinels. Cutting splits descriptors, an arrangement permutes them, and the inverse permutation
restores the text. Bytes are read only when a table is written out or hashed, descriptor by descriptor.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costloom.llm.common import frugal, refuse, small_batches, valid_text, with_text

#: Tokens (fixed pattern): white space and the word after it, or white space at the end.
TOKEN = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: Prefix, suffix and middle sentinel (fixed values).
SENTINELS = ("<P>", "<S>", "<M>")
#: Order of the parts (prefix, suffix, middle sentinel; prefix, middle, suffix) in each form.
PREFIX, MIDDLE, SUFFIX = 3, 4, 5
FORMS = {"psm": (0, PREFIX, 1, SUFFIX, 2, MIDDLE), "spm": (1, SUFFIX, 0, PREFIX, 2, MIDDLE)}
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class PieceTable:
    """Descriptors over immutable buffers."""

    def __init__(self, buffers: list[bytes], pieces: list[tuple[int, int, int]]):
        self.buffers, self.pieces = buffers, pieces

    def cut(self, *offsets: int) -> PieceTable:
        """Pieces split at ascending offsets of the written-out bytes; an offset at an edge gives an empty piece there."""
        out, done, todo = [], 0, list(offsets)
        for b, start, stop in self.pieces:
            while todo and todo[0] <= done + stop - start:
                at = start + todo.pop(0) - done
                out.append((b, start, at))
                done, start = done + at - start, at
            out.append((b, start, stop))
            done += stop - start
        return PieceTable(self.buffers, out)

    def arrange(self, order) -> PieceTable:
        """The pieces in another order."""
        return PieceTable(self.buffers, [self.pieces[k] for k in order])

    def restore(self, order) -> PieceTable:
        """The inverse of :meth:`arrange`."""
        out = [(0, 0, 0)] * len(self.pieces)
        for k, piece in zip(order, self.pieces):
            out[k] = piece
        return PieceTable(self.buffers, out)

    def stream(self):
        for b, start, stop in self.pieces:
            yield memoryview(self.buffers[b])[start:stop]

    def digest(self) -> str:
        """SHA-256 of the written-out bytes."""
        h = hashlib.sha256()
        for part in self.stream():
            h.update(part)
        return h.hexdigest()

    def written(self) -> bytes:
        return b"".join(self.stream())


def token_ends(text: bytes) -> np.ndarray:
    """The byte offsets at which the tokens of a text end."""
    space = SPACE[np.frombuffer(text, np.uint8)]
    last = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(last, len(text)) if text else last


def chars(text) -> int:
    """Code points of valid UTF-8."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def check_sentinels(sentinels) -> list[bytes]:
    """Sentinels must be found again: none is empty, and none begins with another's end."""
    out = [s.encode() for s in sentinels]
    for a in out:
        for b in out:
            if not a or (a is not b and a in b) or any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)))):
                raise ValueError("sentinels may not overlap")
    return out


def draw(seed: int, key: str) -> list[int]:
    """Four unsigned numbers of 32 bits, from the SHA-256 of seed and key."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(h[4 * k : 4 * k + 4], "big") for k in range(4)]


def arranged(text: bytes, key: str, marks: list[bytes], seed: int, rate: int, spm_rate: int) -> tuple[int, str, PieceTable]:
    """Number of tokens, form and the arranged table of one document."""
    ends = token_ends(text)
    n = len(ends)
    buffers = [text, b"".join(marks)]
    table = PieceTable(buffers, [(0, 0, len(text))])
    h = draw(seed, key)
    if not text or h[2] % 100 >= rate or any(m in text for m in marks):
        return n, "plain", table
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    edges = [0, *ends.tolist()]
    parts = table.cut(edges[a], edges[b])
    at = np.cumsum([0, *map(len, marks)]).tolist()
    full = PieceTable(buffers, [*((1, x, y) for x, y in zip(at, at[1:])), *parts.pieces])
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    return n, form, full.arrange(FORMS[form])


def fill_in_middle(docs: DataFrame, carry: list[str], key: str = "doc_id", seed: int = 42, rate: int = 50, spm_rate: int = 80, sentinels=SENTINELS) -> DataFrame:
    """``carry`` columns plus ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output`` and ``output_sha256`` for every row.

    ``n`` counts the text's tokens; the cuts lie between tokens and are drawn from ``seed`` and the key
    (a null key: the empty text), so repeated rows are transformed alike. ``rate`` percent of the texts are
    arranged, ``spm_rate`` percent of these suffix first; null and empty texts, and texts that hold a
    sentinel, stay ``plain``, without part sizes. Bytes that aren't UTF-8 count as U+FFFD. Texts are
    taken whole; an empty table gives no rows. Carried columns may not bear a result's name (ValueError).
    """
    own = ["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    refuse(carry, own)
    marks = check_sentinels(sentinels)
    rows, at = with_text(docs.withColumn("__key", F.coalesce(F.col(key).cast("string"), F.lit(""))), [*carry, "__key"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema.fields)

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in own]
            size, begin = 0, 0
            keys = batch.column(len(carry))
            texts = batch.column(at).cast(pa.binary())
            for k in range(batch.num_rows):
                text = texts[k].as_py() or b""
                n, form, table = arranged(text, keys[k].as_py(), marks, seed, rate, spm_rate)
                sizes = (None, None)
                if form != "plain":
                    pieces = table.restore(FORMS[form]).pieces
                    sizes = tuple(chars(text[pieces[p][1] : pieces[p][2]]) for p in (PREFIX, MIDDLE))
                for column, value in zip(out, (n, form, *sizes, table.written(), table.digest())):
                    column.append(value)
                size += len(text)
                if size > 2_000_000 or k == batch.num_rows - 1:
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
                    made = [pa.array(c, t) for c, t in zip(out, kinds)]
                    made[4] = made[4].cast(pa.string())
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(begin, k + 1 - begin) for i in range(len(carry))), *made], [*carry, *own])
                    out, size, begin = [[] for _ in own], 0, k + 1

    tail = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"
    return rows.mapInArrow(frugal(run), ", ".join(x for x in (fields, tail) if x))


def restored(output: bytes, form, marks: list[bytes]) -> PieceTable | None:
    """The table of the text behind an output, found from the output and its form alone; None if its sentinels aren't there."""
    table = PieceTable([output], [(0, 0, len(output))])
    if form not in FORMS:
        return table
    edges, at = [], 0
    for part in FORMS[form]:
        if part < PREFIX:
            at = output.find(marks[part], at)
            if at < 0 or (not edges and at):
                return None
            edges += [at, at + len(marks[part])]
            at = edges[-1]
    pieces = table.cut(*edges[1:]).restore(FORMS[form]).pieces
    return PieceTable([output], pieces[PREFIX:])


def restore(rows: DataFrame, carry: list[str], sentinels=SENTINELS) -> DataFrame:
    """``carry`` columns plus ``restored`` and ``restored_sha256``, rebuilt from ``output`` and ``form``.

    A form other than ``spm`` and ``psm`` is taken as plain. Null outputs, and outputs without their
    form's sentinels, give nulls. Repeated rows are restored alike; an empty table gives no rows. Carried
    columns may not be called ``restored`` or ``restored_sha256`` (ValueError).
    """
    own = ["restored", "restored_sha256"]
    refuse(carry, own)
    marks = check_sentinels(sentinels)
    small_batches(rows.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*carry).schema.fields)

    def run(batches):
        for batch in batches:
            texts, hashes = [], []
            for output, form in zip(batch.column(len(carry)), batch.column(len(carry) + 1).to_pylist()):
                data = output.as_py()
                table = None if data is None else restored(data, form, marks)
                texts.append(None if table is None else table.written())
                hashes.append(None if table is None else table.digest())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(hashes, pa.string())], [*carry, *own])

    sent = rows.select(*carry, valid_text(F.col("output")).cast("binary").alias("__output"), F.col("form").alias("__form"))
    return sent.mapInArrow(frugal(run), ", ".join(x for x in (fields, "restored string, restored_sha256 string") if x))
