"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costloom.llm import decontaminate, encoding, fim, idfiles, jaccard, langid, lm, quality, ranked, rules, sharding, urls, warc
from costloom.llm.common import durable, fold, fresh_path, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; rows with crc32(doc_id) mod 4 = 2 are held out."""
    held_out = fold(F.col("doc_id"), 4) == 2
    docs = table(spark, sf_dir, "documents")
    scored = quality.classify(docs, table(spark, sf_dir, "labels"), ~held_out, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; rows with crc32(doc_id) mod 3 = 1 are held out."""
    held_out = fold(F.col("doc_id"), 3) == 1
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, ~held_out, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_char")


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice and word-unigram log10 probabilities of all documents; rows with crc32(doc_id) mod 10 = 0 are held out."""
    held_out = fold(F.col("doc_id"), 10) == 0
    scored = lm.score_documents(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "word_score")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, read back and assembled into captures."""
    path = fresh_path(spark, "warc")
    warc.write_captures(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read_records(spark, path))
    page = F.col("metadata.fields")["pageId"].cast("long")
    revisit = F.col("response.kind") == "revisit"
    rows = captures.select(
        page.alias("page_id"),
        F.when(revisit, F.col("metadata.fields")["payloadBytes"].cast("long")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("response.declared_digest")).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        # a response stands for itself, so that no null key gathers all responses in one task
        F.coalesce("response.refers_to", "capture").alias("target"),
        F.col("capture"),
    )
    referred = rows.where("record_type = 'response'").select(F.col("capture").alias("target"), F.col("page_id").alias("first"))
    joined = rows.join(referred, "target", "left")
    return joined.select("page_id", "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("first")).alias("refers_to"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a Jaccard similarity of 0.85 over 4-word shingles."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the quality rules on all documents."""
    measured = durable(rules.measure(table(spark, sf_dir, "documents"), ["doc_id", "lang"]), "quality-counts")
    judged = rules.apply_rules(measured, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The rules of the URL filter query: host, path, verdict (fixed values).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page URLs; those that no rule fits are allowed."""
    given = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), given, ["page_id"], default="allow")
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    found = decontaminate.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight runs of a Hilbert order over source, language and size; law ``rows``."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    placed = sharding.shard_by_hilbert(rows, "doc_id", {"source": False, "lang": False, "size": True}, group="text_hash")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of all documents, and whether decoding gives the texts back."""
    encoded = encoding.encode_texts(table(spark, sf_dir, "documents"), ["doc_id"])
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "decoded_crc32", "round_trip")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in fill-in-middle form, and the texts rebuilt from the outputs."""
    carry = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"), ["doc_id"])
    return fim.restore(made, carry).select(*carry, "restored_sha256")


def op12_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written to range-coded files and read back."""
    path = fresh_path(spark, "ids")
    docs = table(spark, sf_dir, "documents")
    idfiles.write_ids(docs, path)
    back = idfiles.read_ids(spark, path)
    return back.select(F.col("key").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "start", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_language_id": op2_language_id,
    "op3_lattice_lm": op3_lattice_lm,
    "op4_warc": op4_warc,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality_rules": op6_quality_rules,
    "op7_url_filter": op7_url_filter,
    "op8_decontamination": op8_decontamination,
    "op9_hilbert_sharding": op9_hilbert_sharding,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_range_coded_ids": op12_range_coded_ids,
    "op13_ranked_search": op13_ranked_search,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: DuckDB statements of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op4_warc": """
        WITH p AS (
          SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
        ), d AS (
          SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
            translate(list_aggregate([lpad(to_base(('0x' || substr(h, (1 + 5 * g)::INT, 5))::BIGINT, 32), 4, '0') FOR g IN range(8)], 'string_agg', ''),
              '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
            max(page_id) OVER (PARTITION BY html) AS last_id
          FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
          CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id <> last_id THEN last_id END AS refers_to
        FROM d
    """,
    "op7_url_filter": """
        WITH u AS (
          SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), h AS (
          SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
          FROM u
        ), r(rhost, rpath, verdict) AS (
          VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), m AS (
          SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
          FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
          GROUP BY page_id
        )
        SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)
    """,
    "op5_jaccard_join": f"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
        ), s AS (
          SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 4 THEN [array_to_string(ws[i:i+3], ' ') FOR i IN range(1, len(ws) - 2)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS sh FROM w
        ), n AS (
          SELECT doc_id, count(*) AS n FROM s GROUP BY 1
        ), pairs AS (
          SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY 1, 2
        ), e AS (
          SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
        ), both_ways AS (
          SELECT a, b FROM e UNION ALL SELECT b, a FROM e
        ), reach AS (
          SELECT DISTINCT doc_id AS id, doc_id AS c FROM documents UNION SELECT b, c FROM reach JOIN both_ways ON a = id
        )
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM reach GROUP BY 1) r ON r.id = d.doc_id
    """,
    "op8_decontamination": f"""
        WITH w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
        ), i AS (
          SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
        ), win AS (
          SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[p:p+9], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM i WHERE len(ws) > 0)
        ), pos AS (
          SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM w, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n
        ), hit AS (
          SELECT doc_id, p, pos.n, item_id FROM pos JOIN win ON win.n = pos.n AND win.k = array_to_string(ws[p:p+pos.n-1], ' ')
        ), covered AS (
          SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY 1
        ), items AS (
          SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY 1
        )
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op11_fill_in_middle": r"""
        WITH t AS (
          SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS ts FROM documents
        ), h AS (
          SELECT *, len(ts)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t
        ), c AS (
          SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h
        ), p AS (
          SELECT *, array_to_string(ts[1:a], '') AS prefix, array_to_string(ts[a + 1:b], '') AS middle, array_to_string(ts[b + 1:n], '') AS suffix FROM c
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
        FROM p
    """,
    "op13_ranked_search": f"""
        WITH d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents
        ), i AS (
          SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
        ), q AS (
          SELECT item_id, t, count(*) AS times FROM i GROUP BY 1, 2
        ), s AS (
          SELECT count(*) AS nn, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0
        ), p AS (
          SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d) GROUP BY 1, 2, 3
        ), w AS (
          SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s WHERE t IN (SELECT t FROM q) GROUP BY t, nn
        ), r AS (
          SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l))))::BIGINT AS score
          FROM q JOIN w USING (t) JOIN p USING (t), s GROUP BY 1, 2
        ), o AS (
          SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20
    """,
}
