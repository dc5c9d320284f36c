"""Token ids in binary files: adaptive range-coded blocks, written in the order of a key and read back.

A file is a sequence of records, each followed by one line end (Spark's text writer puts the record's
bytes down as they are). A record is

    magic "CLTW" | kind (1 byte) | file, group (4 bytes each) | count, start (8 bytes each) |
    words of a block, bytes of the payload, CRC-32 of the ids, CRC-32 of all before and after it (4 bytes each) | payload

in little-endian numbers. A record ``D`` opens a group of whole documents: their count, the ids of the
file before the group, their keys and how many ids each has, and the ids of every different word of the group, once
each. A word is a run of ids that the tokenizer gives for a white-space word; the end id is a word too. The group's words
follow as numbers in records ``B``, one for each block (count and start are in words), each coded from a fresh model
(:mod:`costloom.llm.idcoder`) and with checksums of its own, of the coded bytes and of the ids that they stand for, so a
damaged block is found and named, and a group's blocks can be decoded in any order.

Files come from range partitions that are sorted by the key, so the files' numbers are their order.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from costloom.llm import idcoder
from costloom.llm.common import frugal, held, small_batches, text_slices, valid_text

MAGIC = b"CLTW"
HEAD = struct.Struct("<4scIIQQIIII")


#: How the public tokenizer prepares texts (fixed values of its file): normal form C, white space as one space, lower case; then words by a pattern.
PREPARES = (["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words of visible ASCII characters and Latin-1 letters: in normal form C as they are, and split by the pattern's part for them.
SIMPLE = re.compile(r"[!-~\xC0-\xD6\xD8-\xF6\xF8-\xFF]+")
ALL_SIMPLE = re.compile(r"[\n!-~\xC0-\xD6\xD8-\xF6\xF8-\xFF]+")
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xDF-\xF6\xF8-\xFF]+|[0-9]|[^a-z0-9\xDF-\xF6\xF8-\xFF]+")


#: Kinds of bytes in the UTF-8 of words; a word with one of OTHER isn't split by its bytes.
LETTER, DIGIT, MARK, OTHER = range(4)


def byte_kinds() -> np.ndarray:
    """The kind of each byte, for words of SIMPLE's characters: 0xC3 begins the Latin-1 letters, whose second bytes are letters as well, but for those
    of the signs between them. Apostrophes begin endings of their own, so they count as OTHER."""
    out = np.full(256, OTHER, np.uint8)
    for b in range(0x21, 0x7F):
        out[b] = LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else MARK
    out[0xC3] = out[0x80:0xC0] = LETTER
    out[[ord("'"), 0x97, 0xB7]] = OTHER
    return out


def lower_bytes() -> np.ndarray:
    """Each byte of such words in lower case."""
    out = np.frombuffer(bytes(range(256)).lower(), np.uint8).copy()
    out[0x80:0x9F] += 0x20
    return out


KINDS, LOWER = byte_kinds(), lower_bytes()


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: visible Latin-1 characters for themselves, the others from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b) if b in visible else chr(next(others)) for b in range(256)}


class Encoder:
    """Ids of texts by a tokenizer of the tokenizers library.

    White space only separates words for this kind of tokenizer, so a text's ids are those of its
    white-space words, which repeat: a caller asks for each different one once. Simple words are split all at once,
    by array operations on their bytes, but for those with apostrophes, which are split one by one. The
    parts are merged by the library's model, many in one call; about ``most`` parts and words with apostrophes are remembered; all others of a call are
    encoded by the library whole, parted by a word that is a single control character. A tokenizer that prepares texts otherwise than the public one
    gets all words that way.
    """

    PART = "\x01"

    def __init__(self, model: str, most: int = 1_000_000):
        self.library = Tokenizer.from_str(model)
        self.size = self.library.get_vocab_size()
        self.parts: dict[str, bytes] = {}
        self.most = most
        self.part = self.library.encode(self.PART, add_special_tokens=False).ids
        between = self.library.encode(f"a {self.PART}\n\t{self.PART} a", add_special_tokens=False).ids
        alone = self.library.encode("a", add_special_tokens=False).ids
        if len(self.part) != 1 or between != [*alone, *self.part, *self.part, *alone]:
            raise ValueError("white space has to separate words in this tokenizer")
        self.model = self.library.model
        self.merging = Tokenizer(self.model)
        self.merging.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        last = getattr(self.model, "end_of_word_suffix", None)
        self.ending = np.zeros(self.size, bool)
        self.ending[[i for t, i in self.library.get_vocab().items() if last and t.endswith(last)]] = True
        self.letters = {b: x for b, x in byte_letters().items() if b > 0x20}
        self.special = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        own = self.prepares(json.loads(model)) == PREPARES
        self.simple, self.all_simple = (SIMPLE, ALL_SIMPLE) if own else [re.compile("(?!)")] * 2
        self.kinds = KINDS if own else np.full(256, OTHER, np.uint8)

    @staticmethod
    def prepares(file: dict) -> tuple:
        """What :data:`PREPARES` says of a tokenizer's file, as far as the file has the same shape."""
        before, split = file.get("normalizer") or {}, (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        rest = [(x.get("type"), x.get("use_regex"), x.get("add_prefix_space")) for x in split[1:]]
        if rest != [("ByteLevel", False, False)] or file["model"].get("type") != "BPE" or not split[0].get("invert") or split[0].get("behavior") != "Removed":
            return ()
        return [x.get("type") for x in before.get("normalizers", [])], (split[0].get("pattern") or {}).get("Regex")

    def merge(self, parts: list[str]) -> list[bytes]:
        """Ids of parts of simple words, which are remembered: many in one call of the library's model, told apart by the tokens that end a word."""
        out: list[bytes] = []
        for lo in range(0, len(parts), 500):
            some = parts[lo : lo + 500]
            spelled = " ".join(some)
            if not spelled.isascii():
                spelled = spelled.encode().decode("latin-1").translate(self.letters)
            found = np.array(self.merging.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<i4")
            ends = (4 * (np.flatnonzero(self.ending[found]) + 1)).tolist()
            if len(ends) == len(some) and ends[-1] == 4 * len(found):
                data = found.tobytes()
                out += [data[i:j] for i, j in zip([0, *ends], ends)]
            else:  # a vocabulary without marks for the ends of words
                out += [array("I", [t.id for t in self.model.tokenize(x)]).tobytes() for x in spelled.split(" ")]
        self.parts.update(zip(parts, out))
        return out

    def ask(self, texts: list[str]) -> list[bytes]:
        """Ids of words by the library alone."""
        plain = [k for k, t in enumerate(texts) if self.PART not in t]
        found = np.array(self.library.encode_batch_fast([f" {self.PART} ".join(texts[k] for k in plain)], add_special_tokens=False)[0].ids, "<i4")
        cuts = np.flatnonzero(found == self.part[0])
        if len(cuts) != max(0, len(plain) - 1):  # a word that gives the parting id in another way
            found, cuts, plain = found[:0], cuts[:0], []
        edges = np.concatenate([[-1], cuts, [len(found)]])
        data, out = found.tobytes(), [b""] * len(texts)
        for k, a, b in zip(plain, edges, edges[1:]):
            out[k] = data[4 * (a + 1) : 4 * b]
        rest = sorted(set(range(len(texts))) - set(plain))
        for k, e in zip(rest, self.library.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
            out[k] = np.array(e.ids, "<i4").tobytes()
        return out

    def ids_of(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of white-space words, none of them empty, as little-endian 32-bit numbers."""
        if len(self.parts) > self.most:
            self.parts.clear()
        data, edges = flat(words)
        plain = np.maximum.reduceat(self.kinds[data], edges[:-1]) < OTHER if len(words) else np.zeros(0, bool)
        small = LOWER[data].tobytes()
        if any(t.encode() in small for t in self.special):
            lower = pc.utf8_lower(words)
            for t in self.special:
                plain &= ~pc.match_substring(lower, t).to_numpy(zero_copy_only=False)
        if plain.all():
            return self.plain_ids(words)
        rest = ~plain
        out = pa.concat_arrays([self.plain_ids(words.filter(pa.array(plain))), pa.array(self.other_ids(lines_of(words.filter(pa.array(rest)))), pa.large_binary())])
        # each word's row: the plain ones come first
        return out.take(pa.array(np.where(plain, np.cumsum(plain) - 1, np.count_nonzero(plain) + np.cumsum(rest) - 1)))

    def plain_ids(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of simple words without apostrophes: a part is a run of letters, one digit or a run of other characters."""
        if not len(words):
            return pa.array([], pa.large_binary())
        data, edges = flat(words)
        kind = self.kinds[data]
        first = kind == DIGIT
        first[1:] |= kind[1:] != kind[:-1]
        first[edges[:-1]] = True
        begins = np.append(np.flatnonzero(first), len(data)).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), pa.py_buffer(LOWER[data])).dictionary_encode()
        names = lines_of(parts.dictionary)
        found = list(map(self.parts.get, names))
        new = [k for k, ids in enumerate(found) if ids is None]
        for k, own in zip(new, self.merge([names[k] for k in new])):
            found[k] = own
        ids, at = spelled_out(parts.indices, pa.array(found, pa.large_binary()))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(at[np.searchsorted(begins, edges)]), pa.py_buffer(ids)])

    def other_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of words of any kind."""
        whole = "\n".join(texts)
        small = whole.lower()
        odd: list[int] = []
        if not self.all_simple.fullmatch(whole) or any(t in small for t in self.special):
            odd = [k for k, t in enumerate(texts) if not self.simple.fullmatch(t) or any(x in t.lower() for x in self.special)]
            others = set(odd)
            small = "\n".join(["" if k in others else t for k, t in enumerate(texts)]).lower()
        lower = small.split("\n")
        out = list(map(self.parts.get, lower))
        rest = [k for k, ids in enumerate(out) if ids is None]
        split = [[t] if t.isalpha() else SPLIT.findall(t) for t in map(lower.__getitem__, rest)]
        self.merge(list(set(chain.from_iterable(split)).difference(self.parts)))
        of = self.parts.__getitem__
        for k, parts in zip(rest, split):
            out[k] = b"".join(map(of, parts))
        self.parts.update(zip(map(lower.__getitem__, rest), map(out.__getitem__, rest)))
        if odd:
            for k, ids in zip(odd, self.ask([texts[k] for k in odd])):
                out[k] = ids
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts (UTF-8) as little-endian 32-bit numbers."""
        split = [t.split() for t in texts]
        words = list(set().union(*split))
        of = dict(zip(words, self.ids_of(pa.array(words, pa.binary()).cast(pa.string())).to_pylist())).__getitem__
        return [b"".join(map(of, words)) for words in split]


def lines_of(words: pa.StringArray) -> list[str]:
    """An array of words, which have no line ends, as a list; by one long text, as single values are slow to take from Arrow."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py().split("\n")


def flat(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words in a row, and where each word begins (and the last one ends) in them."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int32)
    edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]], edges - edges[0]


class Group:
    """Documents whose words are numbered as they come; 0 is the end of a document."""

    def __init__(self, encoder: Encoder, end: int):
        if not 0 <= end < encoder.size:
            raise ValueError("an id outside the vocabulary")
        self.encoder = encoder
        # a word's number is its place; white space at a text's edges gives empty words, which are left out
        self.numbers = pa.array([""], pa.string())
        self.words, self.sizes = pa.array([int(end).to_bytes(4, "little")], pa.large_binary()), np.ones(1, np.int64)
        self.keys, self.counts, self.parts, self.size = [], [], [], 0

    def add(self, keys: list, texts: pa.Array) -> None:
        """Add documents (UTF-8 texts without null); Arrow splits them and finds the different words."""
        split = pc.ascii_split_whitespace(texts.cast(pa.string()))
        coded = split.flatten().dictionary_encode()
        known = pc.index_in(coded.dictionary, value_set=self.numbers)
        new = coded.dictionary.filter(known.is_null())
        of = known.fill_null(-1).to_numpy().copy()
        of[of < 0] = np.arange(len(self.numbers), len(self.numbers) + len(new))
        self.numbers = pa.concat_arrays([self.numbers, new])
        found = of[coded.indices.to_numpy()]
        docs = np.repeat(np.arange(len(keys)), np.diff(split.offsets.to_numpy()))[found > 0]
        found = found[found > 0]
        part = np.zeros(len(found) + len(keys), np.int32)
        part[np.arange(len(found)) + docs] = found
        ends = np.cumsum(np.bincount(docs, minlength=len(keys)) + 1)
        ids = self.encoder.ids_of(new)
        self.words = pa.concat_arrays([self.words, ids])
        self.sizes = np.concatenate([self.sizes, pc.binary_length(ids).to_numpy() // 4])
        counts = np.diff(np.cumsum(self.sizes[part])[ends - 1], prepend=0)
        self.keys += keys
        self.counts.append(counts)
        self.parts.append(part)
        self.size += int(counts.sum())


def spelled_out(numbers: np.ndarray | pa.Array, words: pa.LargeBinaryArray) -> tuple[memoryview, np.ndarray]:
    """The ids of numbered words in a row, as bytes, and where each word's ids begin (and the last ones end) in them."""
    rows = words.take(pa.array(numbers))
    edges = np.frombuffer(rows.buffers()[1], "<i8")[: len(numbers) + 1]
    return memoryview(rows.buffers()[2]), edges


def model_text(path: str | None, name: str = "word_bpe_49k.json") -> str:
    """A tokenizer file's contents (a few MB); without a path, the public one of the installed package."""
    with open(path or public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def packed_keys(keys: list, counts: np.ndarray) -> bytes:
    """Keys (texts or null) and numbers of ids of a group's documents."""
    data = [b"" if k is None else k.encode() for k in keys]
    lengths = np.array([0xFFFFFFFF if k is None else len(d) for k, d in zip(keys, data)], "<u4")
    return zlib.compress(counts.astype("<u8").tobytes() + lengths.tobytes() + b"".join(data), 6)


def unpacked_keys(payload: bytes, n: int) -> tuple[list, np.ndarray]:
    data = zlib.decompress(payload)
    counts, lengths = np.frombuffer(data, "<u8", n), np.frombuffer(data, "<u4", n, 8 * n)
    keys, at = [], 12 * n
    for size in lengths.tolist():
        if size == 0xFFFFFFFF:
            keys.append(None)
        else:
            keys.append(data[at : at + size].decode())
            at += size
    return keys, counts.astype(np.int64)


def packed_words(words: pa.LargeBinaryArray) -> bytes:
    """The ids of a group's different words."""
    data, edges = spelled_out(np.arange(len(words)), words)
    ids = np.frombuffer(data, "<u4", int(edges[-1]) // 4)
    narrow = ids.astype("<u2") if not len(ids) or int(ids.max()) < 1 << 16 else ids
    sizes = np.diff(edges) // 4
    return struct.pack("<IB", len(words), narrow.itemsize) + zlib.compress(sizes.astype("<u4").tobytes() + narrow.tobytes(), 1)


def unpacked_words(payload: bytes) -> pa.LargeBinaryArray:
    n, width = struct.unpack_from("<IB", payload)
    data = zlib.decompress(memoryview(payload)[5:])
    edges = np.concatenate([[0], np.cumsum(np.frombuffer(data, "<u4", n), dtype=np.int64)]) * 4
    ids = np.frombuffer(data, f"<u{width}", -1, 4 * n).astype("<u4")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(edges.astype("<i8").tobytes()), pa.py_buffer(ids.tobytes())])


def record(kind: bytes, file: int, group: int, count: int, start: int, length: int, ids_crc: int, payload: bytes) -> bytes:
    head = HEAD.pack(MAGIC, kind, file, group, count, start, length, len(payload), ids_crc, 0)[:-4]
    return head + zlib.crc32(payload, zlib.crc32(head)).to_bytes(4, "little") + payload


def records(data: bytes, kinds: bytes = b"DB"):
    """(kind, file, group, count, start, block length, CRC of the ids, payload) of a file's records, checked."""
    view, at = memoryview(data), 0
    while at < len(view):
        if len(view) - at < HEAD.size:
            raise ValueError(f"a record's head is cut off at byte {at}")
        magic, kind, file, group, count, start, length, size, ids_crc, crc = HEAD.unpack_from(view, at)
        end = at + HEAD.size + size
        if magic != MAGIC or end > len(view):
            raise ValueError(f"no whole record at byte {at}")
        if kind in kinds:
            if zlib.crc32(view[at + HEAD.size : end], zlib.crc32(view[at : at + HEAD.size - 4])) != crc:
                raise ValueError(f"a damaged record at byte {at} of file {file}")
            yield kind, file, group, count, start, length, ids_crc, bytes(view[at + HEAD.size : end])
        at = end + 1


def group_records(file: int, number: int, start: int, group: Group, length: int):
    """The records of a group of documents."""
    numbers = np.concatenate(group.parts)
    keys, words = packed_keys(group.keys, np.concatenate(group.counts)), packed_words(group.words)
    yield record(b"D", file, number, len(group.keys), start, length, 0, len(keys).to_bytes(4, "little") + keys + words)
    data, edges = spelled_out(numbers, group.words)
    for k, payload in enumerate(idcoder.encode(numbers, length, len(group.words))):
        lo, hi = k * length, min(len(numbers), (k + 1) * length)
        yield record(b"B", file, number, hi - lo, lo, length, zlib.crc32(data[edges[lo] : edges[hi]]), payload)


def block_length(n: int, most: int, least: int, lanes: int) -> int:
    """Words of a block: ``most``, but fewer where a group would have less than ``lanes`` blocks to code side by side."""
    return max(min(least, most), min(most, -(-n // lanes)))


def write_ids(docs: DataFrame, path: str, key: str = "doc_id", tokenizer: str | None = None, end: int = 1, block: int = 1024, group_ids: int = 4_000_000, file_bytes: int = 24_000_000) -> None:
    """Write the ids of all texts of ``docs`` (key, text) under ``path``, in ascending order of the key.

    Every text is encoded whole and followed by the id ``end``; null and empty texts are that id alone.
    Null keys come first; rows of one key are in the order of a hash of their texts; repeated rows all
    stay. Bytes of a text that aren't UTF-8 count as U+FFFD. Files hold about ``file_bytes`` of text, so a
    key that a large part of the rows has spreads over files by that hash; groups hold about ``group_ids``
    ids and whole documents, blocks up to ``block`` words. An empty table writes files without records. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(model_text(tokenizer))
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(valid_text(F.col("text")), F.lit("")).alias("__text")).withColumn("__hash", F.xxhash64("__text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-int(total) // file_bytes))
    ordered = rows.repartitionByRange(files, "__key", "__hash").sortWithinPartitions("__key", "__hash").select(F.col("__key").cast("string").alias("key"), F.col("__text").cast("binary").alias("text"))

    def run(batches):
        encoder = held(("ids", zlib.crc32(model.value.encode())), lambda: Encoder(model.value))
        file, number, start = TaskContext.get().partitionId(), 0, 0
        group = Group(encoder, end)

        def close():
            n = sum(map(len, group.parts))
            for r in group_records(file, number, start, group, block_length(n, block, 512, 512)):
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.binary())], ["record"])

        for keys, texts in gathered(batches, min(4_000_000, group_ids)):
            group.add(keys, texts)
            if group.size >= group_ids:
                yield from close()
                number, start = number + 1, start + group.size
                group = Group(encoder, end)
        if group.keys:
            yield from close()

    coded = ordered.mapInArrow(frugal(run), "record binary")
    coded.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def key_part(payload: bytes) -> memoryview:
    """What :func:`packed_keys` made of a group's record; its words follow."""
    return memoryview(payload)[4 : 4 + int.from_bytes(payload[:4], "little")]


def gathered(batches, limit: int):
    """(keys, texts) of batches of a key and a text, joined or cut to about ``limit`` bytes of text, as words that texts share are then looked up once."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for lo, hi, column in text_slices(batch.column(1), limit):
            keys += batch.column(0).slice(lo, hi - lo).to_pylist()
            texts.append(column)
            size += pc.sum(pc.binary_length(column)).as_py() + hi - lo  # a byte a text more, as texts may be empty
            if size >= limit:
                yield keys, pa.concat_arrays(texts)
                keys, texts, size = [], [], 0
    if keys:
        yield keys, pa.concat_arrays(texts)


def files_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def file_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """The ids of all files before each file; one number a file reaches the driver."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                sizes: dict[int, int] = {}
                for _, file, _, n, _, _, _, payload in records(content.as_py(), b"D"):
                    sizes[file] = sizes.get(file, 0) + int(unpacked_keys(key_part(payload), n)[1].sum())
                yield pa.RecordBatch.from_arrays([pa.array(list(sizes), pa.int64()), pa.array(list(sizes.values()), pa.int64())], ["file", "n"])

    sizes = files_of(spark, path).mapInArrow(frugal(run), "file long, n long").groupBy("file").agg(F.sum("n").alias("n")).collect()
    out, total = {}, 0
    for r in sorted(sizes):
        out[r["file"]] = total
        total += r["n"]
    return out


def read_ids(spark: SparkSession, path: str, size: int | None = None, tokenizer: str | None = None) -> DataFrame:
    """(key, start, ids) of all documents in the files under ``path``.

    ``key`` is the key as text, ``start`` the number of ids of all documents before, ``ids`` the
    document's ids as little-endian unsigned 32-bit numbers. ``size`` is the vocabulary's size, by
    default that of the tokenizer. Every record's checksum and every block's ids are checked; a damaged
    or missing block or an id outside the vocabulary raises ValueError.
    """
    size = size or Tokenizer.from_str(model_text(tokenizer)).get_vocab_size()
    starts = spark.sparkContext.broadcast(file_starts(spark, path))

    def documents(held_group):
        (_, file, _, n, start, length, _, payload), blocks = held_group
        own = key_part(payload)
        keys, counts = unpacked_keys(own, n)
        words = unpacked_words(memoryview(payload)[4 + len(own) :])
        if int(np.frombuffer(words.buffers()[2], "<u4").max(initial=0)) >= size:
            raise ValueError(f"an id outside the vocabulary in file {file}")
        numbers = idcoder.decode([b[7] for b in blocks], sum(b[3] for b in blocks), length, len(words))
        if len(numbers) and not 0 <= int(numbers.min()) <= int(numbers.max()) < len(words):
            raise ValueError(f"an unknown word in file {file}")
        data, edges = spelled_out(numbers, words)
        ends = np.cumsum(counts)
        if edges[-1] != 4 * ends[-1]:
            raise ValueError(f"a block is missing in file {file}")
        for k, b in enumerate(blocks):
            if zlib.crc32(data[edges[b[4]] : edges[b[4] + b[3]]]) != b[6]:
                raise ValueError(f"block {k} of a group in file {file} doesn't give its ids back")
        begins = starts.value[file] + start + ends - counts
        data = pa.py_buffer(data)
        for lo in range(0, n, 2000):
            hi = min(n, lo + 2000)
            edges = (np.concatenate([[0], ends])[lo : hi + 1] * 4).astype(np.int64)
            part = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(edges.tobytes()), data]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(keys[lo:hi], pa.string()), pa.array(begins[lo:hi], pa.int64()), part], ["key", "start", "ids"])

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                group = None
                for r in records(content.as_py()):
                    if r[0] == b"D":
                        if group:
                            yield from documents(group)
                        group = (r, [])
                    elif group:
                        group[1].append(r)
                    else:
                        raise ValueError("a block without its documents")
                if group:
                    yield from documents(group)

    return files_of(spark, path).mapInArrow(frugal(run), "key string, start long, ids binary")
