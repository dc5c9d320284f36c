"""Long words, bytes that aren't UTF-8 and clashing columns in all operators; the pipeline's stages one into another."""

import random
import resource
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F

from costloom.llm import decontaminate, encoding, fim, jaccard, langid, lm, quality, rules

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(k, n=60):
    words = ["the", "old", "house", "of", "stone", "near", "water", "was", "never", "sold", "again", "by", "them", "since", "winter", "under", "light", "field"]
    rng = random.Random(k)
    return " ".join(rng.choice(words) + rng.choice(["", "s", "ly"]) for _ in range(n))


@pytest.fixture(scope="module")
def hard(spark):
    """Usual rows, a word of a million characters, and two rows with bytes that aren't UTF-8."""
    rows = spark.createDataFrame([(k, prose(k), "en", "s", 1) for k in range(30)], COLUMNS)
    long = spark.range(1).select(F.lit(100).cast("long").alias("doc_id"), F.concat(F.expr("repeat('abcdefghij', 50000)"), F.expr("repeat('é日qX', 125000)"), F.lit(" end")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    bad = F.expr("CAST(unhex('746865206f6c6420ff20686f757365c328207761732065e9') AS STRING)")
    broken = spark.range(2).select((F.col("id") + 200).alias("doc_id"), F.concat(F.lit(prose(3, 40) + " "), bad).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    return rows.union(long).union(broken).repartition(3)


def ids_of(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_all_operators_take_long_words_and_broken_bytes(spark, hard):
    want = ids_of(hard)
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, quality int")
    bench = spark.createDataFrame([("i", prose(3, 12))], "item_id string, text string")
    assert ids_of(quality.classify(hard, labels, F.lit(True), ["doc_id"], bits=12)) == want
    assert ids_of(langid.identify(hard, F.lit(True), ["doc_id"])) == want
    scored = {r["doc_id"]: r for r in lm.score_documents(hard, F.col("doc_id") < 20, rounds=1).collect()}
    assert sorted(scored) == want and scored[100]["n_tokens"] == 3 and scored[200]["score"] == scored[201]["score"]
    assert ids_of(rules.measure(hard, ["doc_id"])) == want
    groups = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(hard).collect()}
    assert sorted(groups) == want and groups[201] == groups[200]
    hits = {r["doc_id"]: r["n_hit"] for r in decontaminate.contaminated_spans(hard, bench, ["doc_id"]).collect()}
    assert sorted(hits) == want and hits[3] > 0 and hits[200] > 0 and hits[100] == 0
    assert ids_of(fim.fill_in_middle(hard, ["doc_id"])) == want
    encoded = {r["doc_id"]: r for r in encoding.encode_texts(hard, ["doc_id", "text"]).collect()}
    assert sorted(encoded) == want and all(r["round_trip"] for r in encoded.values())
    assert "�" in encoded[200]["text"] and encoded[200]["ids"] == encoded[201]["ids"]


def test_ids_of_a_long_word_are_the_librarys(hard):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=encoding.read_model())
    text = hard.where("doc_id = 100").first()["text"][:200_000]
    encoder = encoding.encoder_of(encoding.read_model(), "bpe")
    words = encoder.v.words.findall(encoder.v.mark(text))
    found = encoder.encode(set(words))
    ids = b"".join(found[w] for w in words)
    assert [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)] == sp.encode(text)


def unigram_model(pieces):
    """A small unigram model file: pieces with scores, an unknown piece first (fields of the public model format)."""
    import struct

    def field(number, data):
        return bytes([number << 3 | 2, len(data)]) + data

    out = b""
    for k, (piece, score) in enumerate([("<unk>", 0.0), *pieces]):
        out += field(1, field(1, piece.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + bytes([3 << 3, 2 if k == 0 else 1]))
    return out + field(2, bytes([3 << 3, 1])) + field(3, bytes([3 << 3, 0]) + bytes([4 << 3, 0]))


def test_a_unigram_vocabulary_counts_with_its_own_scores(spark, tmp_path):
    import itertools
    import math

    pieces = [("▁", -3.0), ("▁a", -2.0), ("▁ab", -2.5), ("a", -2.2), ("b", -2.4), ("ab", -1.9), ("ba", -2.1), ("c", -4.0), ("abc", -6.0)]
    path = tmp_path / "small.model"
    path.write_bytes(unigram_model(pieces))
    score = dict(pieces)

    def marginal(word):
        w, total = "▁" + word, 0.0
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            parts = "".join(c + ("\0" if k else "") for c, k in zip(w, (*cuts, 0))).split("\0")
            if all(p in score for p in parts):
                total += math.exp(sum(score[p] for p in parts))
        return math.log10(total)

    texts = ["ab abc", "AbabABC", "c", "", None, "ba ab  ba"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, F.lit(True), model_path=str(path), scores="own").collect()}
    for i, text in enumerate(texts):
        assert math.isclose(rows[i], sum(marginal(w) for w in (text or "").lower().split()), rel_tol=1e-6, abs_tol=1e-9)
    with pytest.raises(ValueError):
        lm.score_documents(docs, F.lit(True), scores="none")


def test_training_takes_a_bounded_number_of_features(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] * 3, "doc_id long, quality int")
    docs = spark.createDataFrame([(k, ("good fine " if k % 2 else "bad poor ") * 20 + prose(k)) for k in range(200)], "doc_id long, text string")
    for most in (60_000_000, 6_000):
        rows = quality.classify(docs, labels, F.lit(True), ["doc_id"], bits=14, max_slots=most).collect()
        assert sum((r["score"] > 0.5) == bool(r["doc_id"] % 2) for r in rows) > 190


def test_memory_of_a_long_word_is_linear():
    code = "from costloom.llm import encoding as E; import resource as R; e = E.encoder_of(E.read_model(), 'bpe'); a = R.getrusage(R.RUSAGE_SELF).ru_maxrss; e.encode({'▁' + 'abcdefghij' * 100000}); print(R.getrusage(R.RUSAGE_SELF).ru_maxrss - a)"
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests/", 1)[0]).stdout)
    assert resource.getpagesize() and grown < 300_000  # kB


@pytest.mark.parametrize("use, name", [
    (lambda d: langid.identify(d, F.lit(True), ["score"]), "score"), (lambda d: rules.measure(d, ["n_words"]), "n_words"), (lambda d: encoding.encode_texts(d, ["ids"]), "ids"), (lambda d: quality.score(d, __import__("numpy").zeros(16, "f4"), ["score"]), "score"),
    (lambda d: decontaminate.contaminated_spans(d, d, ["Spans"]), "Spans"), (lambda d: encoding.decode_ids(d, ["text"]), "text"), (lambda d: rules.measure(d, ["doc_id", "doc_id"]), "other"),
])
def test_clashing_columns_are_refused(hard, use, name):
    with pytest.raises(ValueError):
        use(hard if name == "text" else hard.withColumn(name, F.lit(1.0)))


FOLDER = "/root/testdata/sf0.001"


def test_stages_may_be_chained_before_they_are_written(spark, hard):
    import corpus_pipeline as cp

    first = cp.language_id(spark, hard, FOLDER)
    other = cp.language_id(spark, hard.where("doc_id < 10"), FOLDER)
    second = cp.quality_rules(spark, first, FOLDER)
    third = cp.near_duplicates(spark, second, FOLDER)
    assert ids_of(cp.quality_rules(spark, other, FOLDER)) == list(range(10))
    kept = ids_of(third)
    assert 200 in kept and 201 not in kept and ids_of(first)
    last = cp.sentencepiece(spark, cp.decontamination(spark, third, FOLDER), FOLDER)
    assert ids_of(last) == kept


def test_two_runs_at_once(spark):
    import corpus_pipeline as cp

    found = {}

    def go(k):
        found[k] = sorted(map(tuple, cp.run(spark, FOLDER).select("doc_id", "n_ids").collect()))

    threads = [threading.Thread(target=go, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(found) == 2 and found[0] == found[1] and found[0]


def test_stages_on_nulls_repeats_and_clashing_columns(spark):
    import corpus_pipeline as cp

    same = prose(1)
    rows = [(1, same, "en", "s", 1), (1, same, "en", "t", 1), (None, same, None, None, None), (None, same, None, None, None), (2, same, "en", "s", 1), (None, prose(4), None, None, None), (None, prose(4), None, None, None), (3, None, "en", None, None), (3, None, "en", None, None), (None, None, None, None, None), (None, "", None, None, None), (4, prose(9), "en", "s", 1), (4, prose(11), "en", "s", 1)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(2)
    kept = sorted(((r["doc_id"], r["text"]) for r in cp.near_duplicates(spark, docs, FOLDER).collect()), key=str)
    assert kept == sorted([(1, same), (None, prose(4)), (3, None), (None, None), (None, ""), (4, prose(9)), (4, prose(11))], key=str)
    extra = docs.select("*", F.lit(1).alias("score"), F.lit("x").alias("lang_pred"), F.lit(2).alias("n_words"), F.lit(3).alias("ids"), F.lit(4).alias("spans"), F.lit(5).alias("component_id"))
    for name, stage in cp.STAGES:
        out, none = stage(spark, extra, FOLDER), stage(spark, docs.limit(0), FOLDER)
        assert none.count() == 0
        assert out.columns == none.columns and (name == "sentencepiece" or out.columns == cp.COLUMNS)
        got = sorted(((r["doc_id"], r["lang"]) for r in out.collect()), key=str)
        if name == "language_id":
            assert len(got) == 9 and {x[1] for x in got} == {"en"}
        elif name == "quality_rules":
            assert len(got) == 9 and all(r["text"] for r in out.collect())
        elif name in ("decontamination", "sentencepiece"):
            assert len(got) == len(rows)
