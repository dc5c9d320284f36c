"""Fill-in-middle, id files and ranked search against brute force, with edge cases."""

import hashlib
import math
import pathlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from costloom.llm import fim, idcoder, idfiles, ranked

SHAPE = "doc_id long, text string, n int, score long, key string, item_id string"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BROKEN = "encode(concat('ab ', decode(unhex('e9'), 'ISO-8859-1'), ' cd é'), 'ISO-8859-1')"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = ["the", "cat", "sat", "Été", "naïve", "it's", "日本", "x1", "12", "don't", "mat.", "END"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) + rng.choice(["", " ", "\n\t ", "!"]) for _ in range(60)]
    return [*out, *out[:3], None, "", "   \n", " lead", "a <P> b", "x<S>y z", "one", "<", "<M", "P> <S", "word " * 3000, "ü" * 4000, "\x85 a\xa0b", "<|endoftext|> \x01 end", "İΣ ΑΣ."]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, 1, 2, "k", "i") for i, t in enumerate(texts)] + [(None, "no id at all the cat", 1, 2, "k", "i"), (None, None, None, None, None, None), (4, texts[4], 1, 2, "k", "i")]
    return spark.createDataFrame(rows, SHAPE).repartition(3)


@pytest.fixture(scope="module")
def broken(spark):
    """Rows whose text isn't UTF-8."""
    return spark.range(3).select(F.col("id").alias("doc_id"), F.concat(F.lit("the cat "), F.expr(f"CAST({BROKEN} AS STRING)"), F.lit(" sat")).alias("text"))


def cleaned(text):
    return "" if text is None else text


# 11


def plain_fim(doc_id, text):
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_is_that_of_plain_strings(spark, docs):
    rows = fim.restore(fim.fill_in_middle(docs, ["doc_id", "text"]), ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = cleaned(r["text"])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(r["doc_id"], text)
        assert r["restored"] == text
        assert r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest() and r["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert {r["form"] for r in rows} == {"plain", "spm", "psm"}
    assert fim.fill_in_middle(docs.limit(0), ["doc_id"]).count() == 0


def test_fill_in_middle_edges(spark, docs, broken):
    every = fim.fill_in_middle(docs, ["doc_id"], rate=100, spm_rate=0).where("form = 'spm'").count()
    assert every == 0
    for r in fim.restore(fim.fill_in_middle(broken, ["doc_id"], rate=100), ["doc_id", "form"]).collect():
        assert r["form"] != "plain" and "the cat" in r["restored"] and "�" in r["restored"]
    odd = spark.createDataFrame([("no marks", "spm"), (None, "psm"), ("x<P>a<S>b<M>c", "psm"), ("<P>a<S>b<M>c", "psm"), ("<P>a", None), ("y", "other")], "output string, form string")
    assert [r["restored"] for r in fim.restore(odd, []).collect()] == [None, None, None, "acb", "<P>a", "y"]
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs.withColumn("form", F.lit(1)), ["form"])
    with pytest.raises(ValueError):
        fim.check_sentinels(["<a>", "a>", "x"])
    with pytest.raises(ValueError):
        fim.check_sentinels(["<<", "<", "x"])


def test_piece_tables_cut_permute_and_restore():
    rng = random.Random(2)
    for _ in range(200):
        text = bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 12)))
        cuts = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 4)))
        table = fim.PieceTable([text], [(0, 0, len(text))]).cut(*cuts)
        assert table.written() == text and len(table.pieces) == len(cuts) + 1
        order = list(range(len(table.pieces)))
        rng.shuffle(order)
        moved = table.arrange(order)
        assert moved.restore(order).pieces == table.pieces and moved.digest() == hashlib.sha256(moved.written()).hexdigest()


# 12


@pytest.mark.parametrize("n, length, size", [(0, 8, 5), (1, 8, 5), (8, 8, 5), (9, 8, 5), (5000, 64, 49_408), (5000, 700, 3), (3000, 5000, 70_000), (20_000, 17_000, 300)])
def test_coded_ids_come_back(n, length, size):
    rng = np.random.default_rng(n + length)
    for ids in (rng.integers(0, size, n), rng.zipf(1.4, n) % size, np.full(n, size - 1), np.arange(n) % min(size, 7)):
        ids = ids.astype(np.int32)
        blocks = idcoder.encode(ids, length, size)
        assert len(blocks) == -(-n // length)
        assert np.array_equal(idcoder.decode(blocks, n, length, size), ids)
    if n:
        # each block stands alone
        own = idcoder.encode(ids[:length], length, size)
        assert own[0] == blocks[0]
        with pytest.raises(ValueError):
            idcoder.encode(np.array([size], np.int32), length, size)


def test_prediction_shortens_ids():
    rng = np.random.default_rng(1)
    phrases = [rng.integers(0, 49_408, 8) for _ in range(60)]
    ids = np.concatenate([phrases[k] for k in rng.integers(0, 60, 4000)]).astype(np.int32)
    bits = 8 * sum(map(len, idcoder.encode(ids, 4096, 49_408))) / len(ids)
    assert bits < 3.5  # 32 as they are, 15.6 without prediction


def test_word_ids_are_the_librarys(texts):
    from tokenizers import Tokenizer

    model = idfiles.model_text(None)
    library, own = Tokenizer.from_str(model), idfiles.Encoder(model, most=50)
    given = [*(cleaned(t) for t in texts), "I'LL we've 'sx 's' don''t", "a\x01b \x01 \x01", "ÀÉ œuvre été ½²ªµ ×÷ ¿qué?", "<|EndOfText|>x<|startoftext|>", "z" * 20_000, "\x00 \x1c  x"]
    for _ in range(2):
        for text, ids in zip(given, own.encode([t.encode() for t in given])):
            assert np.frombuffer(ids, "<i4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:40]
    other = idfiles.Encoder(model.replace("NFC", "NFKC"))
    assert other.simple.fullmatch("a") is None


def test_simple_words_are_split_all_at_once():
    from tokenizers import Tokenizer

    model = idfiles.model_text(None)
    library, own = Tokenizer.from_str(model), idfiles.Encoder(model)

    def same(words):
        # a slice, as arrays of words need not begin at their buffer's begin
        found = own.ids_of(pa.array(["left", "out", *words], pa.string())[2:]).to_pylist()
        assert [np.frombuffer(ids, "<i4").tolist() for ids in found] == [library.encode(w, add_special_tokens=False).ids for w in words]

    other, own.other_ids = own.other_ids, None
    same(["Été", "été,", "ÉTÉ.", "ab12c", "AB", "(ab),", "ß\xff\xde"])
    # parts are remembered and not words
    assert set(own.parts) == {"été", ",", ".", "ab", "1", "2", "c", "(", "),", "ß\xff\xfe"}
    own.other_ids = other
    same([])
    same(["don't", "a\xd7b", "<|EndOfText|>x", "\xb5", "\u0130x"])
    rng = random.Random(9)
    letters = [chr(c) for c in range(0x21, 0x250) if not chr(c).isspace()] + ["\u0301", "\u6f22", "\U0001f600"]
    for few in (letters, letters[:94], [*letters[:94], *map(chr, range(0xC0, 0x100))]):
        same(["".join(rng.choices(few, k=rng.randint(1, 12))) for _ in range(200)] + few)


def test_small_batches_are_gathered():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([b"x" * 9] * n, pa.binary())], ["key", "text"]) for n in (1, 0, 2, 30, 3)]
    found = list(idfiles.gathered(iter(batches), 50))
    assert [k for keys, _ in found for k in keys] == [k for b in batches for k in b.column(0).to_pylist()]
    assert [len(keys) for keys, _ in found] == [len(texts) for _, texts in found] and len(found[0][0]) > 3
    assert max(len(keys) for keys, _ in found) <= 12 and not list(idfiles.gathered(iter([]), 50))
    empty = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([b""] * 40, pa.binary())], ["key", "text"])
    assert [len(keys) for keys, _ in idfiles.gathered(iter([empty] * 4), 50)] == [80, 80]


def test_id_files_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(idfiles.model_text(None))
    path = str(tmp_path / "ids")
    idfiles.write_ids(docs, path, block=64, group_ids=500, file_bytes=9000)
    assert len(list(pathlib.Path(path).glob("part-*"))) > 2
    rows = sorted(idfiles.read_ids(spark, path).collect(), key=lambda r: r["start"])
    given = docs.collect()
    assert len(rows) == len(given)
    keys = [None if r["key"] is None else int(r["key"]) for r in rows]
    assert keys == sorted((r["doc_id"] for r in given), key=lambda k: (k is not None, k or 0))
    want = {}
    for r in given:
        want.setdefault(r["doc_id"], []).append([*library.encode(cleaned(r["text"]), add_special_tokens=False).ids, 1])
    at = 0
    for r, k in zip(rows, keys):
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert r["start"] == at and ids in want[k]
        want[k].remove(ids)
        at += len(ids)


def test_damaged_id_files_are_found(spark, docs, tmp_path):
    path = tmp_path / "ids"
    idfiles.write_ids(docs, str(path), block=64, group_ids=500)
    [file] = path.glob("part-*")
    data = bytearray(file.read_bytes())
    assert {r[0] for r in idfiles.records(bytes(data))} == {b"D", b"B"}
    for at in (3, 60, len(data) // 2, len(data) - 9):
        hurt = bytearray(data)
        hurt[at] ^= 64
        with pytest.raises(ValueError):
            list(idfiles.records(bytes(hurt)))
    with pytest.raises(ValueError):
        list(idfiles.records(bytes(data[:-20])))
    empty = str(tmp_path / "empty")
    idfiles.write_ids(docs.limit(0), empty)
    assert idfiles.read_ids(spark, empty).count() == 0


def test_a_group_codes_words_and_not_ids():
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_str(idfiles.model_text(None)), random.Random(5)
    words = ["".join(rng.choices("abcdeorth", k=9)) + rng.choice(["", ",", "'s", "7", "É"]) for _ in range(80)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(6)] + ["", " \t\n ", "\n a\x0b\x0cb  ", "\x1c\x85\xa0 Ⅷ \u3000x"]
    group = idfiles.Group(idfiles.Encoder(idfiles.model_text(None)), 1)
    with pytest.raises(ValueError):
        idfiles.Group(group.encoder, group.encoder.size)
    for some in (texts[:4], texts[4:]):
        group.add([str(k) for k in range(len(some))], pa.array([t.encode() for t in some]))
    want = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert np.concatenate(group.counts).tolist() == list(map(len, want)) and group.size == sum(map(len, want))
    found = list(idfiles.records(b"\n".join([*idfiles.group_records(0, 0, 0, group, 64), b""])))
    # one number for a word or an end, whatever the ids of a word; each different word once
    assert sum(r[3] for r in found[1:]) == sum(len(t.encode().split()) + 1 for t in texts) < group.size / 3
    assert len(idfiles.unpacked_words(found[0][7][4 + len(idfiles.key_part(found[0][7])) :])) == 1 + len({w for t in texts for w in t.encode().split()})
    numbers = idcoder.decode([r[7] for r in found[1:]], sum(r[3] for r in found[1:]), 64, len(group.words))
    assert np.frombuffer(idfiles.spelled_out(numbers, pa.array(group.words, pa.large_binary()))[0], "<u4").tolist() == [i for w in want for i in w]


def test_invalid_texts_have_ids(spark, broken, tmp_path):
    from tokenizers import Tokenizer

    path = str(tmp_path / "ids")
    idfiles.write_ids(broken, path)
    text = broken.select(F.make_valid_utf8("text").alias("t")).first()["t"]
    want = [*Tokenizer.from_str(idfiles.model_text(None)).encode(text, add_special_tokens=False).ids, 1]
    assert [np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in idfiles.read_ids(spark, path).collect()] == [want] * 3


# 13


def brute_search(docs, items, k=20):
    held = [(i, TERM.findall(t.lower() if t.isascii() else "".join(c.lower() if c.isascii() else c for c in t))) for i, t in docs if t]
    held = [(i, ts) for i, ts in held if ts]
    n, total = len(held), sum(len(ts) for _, ts in held)
    out = {}
    for item, text in items:
        q = TERM.findall("".join(c.lower() if c.isascii() else c for c in text))
        scores = []
        for i, ts in held:
            m = 75 + (25 * len(ts) * n) // total
            s = 0
            for t in q:
                tf = ts.count(t)
                if tf:
                    df = sum(t in x for _, x in held)
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((10**9 * tf) // (1000 * tf + 12 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out[item] = [(k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("rows, k", [(16_384, 20), (7, 3)])
def test_search_is_that_of_brute_force(spark, monkeypatch, rows, k):
    rng = random.Random(rows)
    words = [f"w{i}" for i in range(40)] + ["Été", "ñu", "A1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    given = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(150)]
    given += [(500 + i, given[i % 3][1]) for i in range(30)] + [(None, given[0][1]), (None, None), (7, given[7][1]), (900, ""), (901, " ,. "), (902, "W1, w2.W3 été")]
    items = [(f"q{i}", " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)] + [("rep", "w5 w5 w5 w1"), ("none", "nowhere at"), ("long", " ".join(words * 2)), ("empty", ""), ("upper", "W3 ÉTÉ été")]
    if rows < 100:
        # small blocks in the workers, too
        search = ranked.ranked
        monkeypatch.setattr(ranked, "ranked", lambda found, *rest: search(found.repartition(3), *rest))
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in given], "doc_id long, text string, score int, rank string")
    q = spark.createDataFrame([*items, items[0], (None, "w1")], "item_id string, text string")
    got = {}
    for r in ranked.search(df, q, k=k, block_terms=100_000 if rows > 100 else 20).collect():
        got.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in brute_search(given, items, k).items() if x}


def test_search_of_small_blocks_and_masks():
    rng = random.Random(3)
    n, terms = 300, 20
    held = [sorted(rng.sample(range(terms), rng.randint(1, 6))) for _ in range(n)]
    flat, ends = np.array([t for h in held for t in h]), np.cumsum([0, *map(len, held)])
    counts = np.array([rng.randint(1, 4) for _ in flat])
    lengths = np.array([sum(counts[a:b]) + rng.randint(0, 9) for a, b in zip(ends, ends[1:])])
    block = ranked.Block(lengths, ends, flat, counts, n, int(lengths.sum()), terms)
    query = ranked.Query(np.array([1, 3, 5, 7, 9]), np.array([900, 40, 7, 300, 0]))
    masks, docs, edges = block.masks(query)
    assert len({m.tobytes() for m in masks}) == len(masks)
    for m, a, b in zip(masks, edges, edges[1:]):
        for d in docs[a:b]:
            assert [t in held[d] for t in query.terms[block.here]] == m.tolist()
    assert sorted(docs) == [d for d in range(n) if set(held[d]) & {1, 3, 5, 7}]
    per_term = np.zeros(terms, np.int64)
    per_term[query.terms] = query.weights
    every = block.scores(np.sort(docs), per_term)
    found, values, scored = block.best(query, per_term, 10, 1)
    assert sorted(values)[::-1][:10] == sorted(every)[::-1][:10] and scored < len(docs)


def test_search_edges(spark, docs, broken):
    q = spark.createDataFrame([("a", "the cat �"), ("b", None)], "item_id string, text string")
    rows = ranked.search(broken, q).collect()
    assert {(r["item_id"], r["doc_id"]) for r in rows} == {("a", 0), ("a", 1), ("a", 2)}
    assert ranked.search(docs.limit(0), q).count() == 0 and ranked.search(docs, q.limit(0)).count() == 0
