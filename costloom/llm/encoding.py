"""SentencePiece encoding and decoding of text columns. Map-only: every batch encodes its own distinct words."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costloom.llm.common import frugal, held, refuse, small_batches, text_slices, with_text
from costloom.llm.pieces import TrieEncoder, Vocabulary, decode

#: The public vocabulary's name in its package; any SentencePiece model file will do.
MODEL = "piece_bpe_32k.model"


def read_model(path: str | None = None) -> bytes:
    """The model file's contents (a vocabulary of some hundred kB), read once on the driver; without a path the public one's."""
    with open(path or public_tokenizers.path(MODEL), "rb") as f:
        return f.read()


def encoder_of(model: bytes, kind: str) -> TrieEncoder:
    """The worker's encoder of a model."""
    return held(("pieces", zlib.crc32(model), len(model), kind), lambda: TrieEncoder(Vocabulary(model, kind)))


def encode_texts(docs: DataFrame, carry: list[str], model_path: str | None = None, kind: str = "bpe", batch_bytes: int = 1_000_000) -> DataFrame:
    """``carry`` columns plus ``ids`` (array of int), ``decoded_crc32`` and ``round_trip`` for every row.

    ``round_trip`` says that decoding the ids gives the text back; a text with a literal ``▁`` doesn't
    come back, as that is a space then (so in the library). Null and empty texts have no ids and
    round-trip to the empty text. Bytes that aren't UTF-8 are read as U+FFFD. Texts are encoded whole, with
    words of any length; repeated rows alike; an empty table gives no rows; other columns are
    ignored unless carried. Carried columns may not bear a result's name (ValueError). ``kind`` is ``bpe`` or ``unigram``,
    whichever the model is.
    """
    refuse(carry, ["ids", "decoded_crc32", "round_trip"])
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema.fields)
    names = [*carry, "ids", "decoded_crc32", "round_trip"]
    rows, at = with_text(docs, carry)

    def run(batches):
        encoder = encoder_of(shared.value, kind)
        v = encoder.v
        for batch in batches:
            for lo, hi, column in text_slices(batch.column(at), batch_bytes):
                texts = column.to_pylist()
                split = [v.words.findall(v.mark(t)) for t in texts]
                of_word = encoder.encode(set().union(*split)).__getitem__
                parts = [b"".join(map(of_word, words)) for words in split]
                offsets = np.cumsum([0, *(len(p) // 4 for p in parts)])
                ids = np.frombuffer(b"".join(parts), "<i4")
                crcs, same = [], []
                for k, text in enumerate(texts):
                    back = decode(ids[offsets[k] : offsets[k + 1]].tolist(), v)
                    crcs.append(zlib.crc32(back))
                    same.append(back == (text or "").encode())
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(carry))), column, pa.array(crcs, pa.int64()), pa.array(same, pa.bool_())], names)

    return rows.mapInArrow(frugal(run), f"{fields}, ids array<int>, decoded_crc32 long, round_trip boolean")


def decode_ids(rows: DataFrame, carry: list[str], model_path: str | None = None, kind: str = "bpe") -> DataFrame:
    """``carry`` columns plus ``text``, decoded from the ``ids`` of every row; null ids give a null text.

    Bytes that aren't UTF-8 become U+FFFD. Ids outside the vocabulary are an error. No carried column may be
    called ``text`` (ValueError).
    """
    refuse(carry, ["text"])
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(read_model(model_path))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*carry).schema.fields)

    def run(batches):
        v = encoder_of(shared.value, kind).v
        for batch in batches:
            texts = [None if ids is None else decode(ids, v).decode("utf-8", "replace") for ids in batch.column(len(carry)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), pa.array(texts, pa.string())], [*carry, "text"])

    return rows.select(*carry, F.col("ids").alias("__ids")).mapInArrow(frugal(run), f"{fields}, text string")
