"""The registered queries of this subpackage: each operator on its whole table, under production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from deedwork.llm import (
    decontamination,
    exact_dedup,
    filter_audit,
    language_id,
    line_dedup,
    near_dedup,
    packing,
    periodic_runs,
    sharding,
    substring_dedup,
    token_files,
    toxicity,
    warc,
)
from deedwork.session import Tables

QUERIES, ORACLES = {}, {}


def fold_of(count: int):
    """The fold of a document: crc32 of its id as text, modulo ``count``."""
    return F.crc32(F.col("doc_id").cast("string")) % count


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle:
            ORACLES[name] = oracle.strip()
        return fn

    return wrap


@query(
    "op6_exact_dedup",
    r"""
    WITH d AS (
        SELECT doc_id, length(coalesce(text, '')) AS n,
               sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
        FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS k,
                 count(*) OVER (PARTITION BY text_sha256) AS group_size,
                 first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id FROM d)
    SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r
    """,
)
def _op6(t):
    return exact_dedup.exact_dedup(t.documents).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query(
    "op2_line_dedup",
    r"""
    WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM s),
    k AS (SELECT *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
    o AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    m AS (SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.keeper AS lost FROM k LEFT JOIN o ON k.key = o.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
    FROM m GROUP BY doc_id
    """,
)
def _op2(t):
    return line_dedup.line_dedup(t.documents).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op8_decontamination",
    r"""
    WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    bl AS (SELECT *, least(len(w), 10) AS m FROM bw WHERE len(w) > 0),
    g AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS gram FROM bl, unnest(range(1, len(w) - m + 2)) AS t(i)),
    lengths AS (SELECT DISTINCT m FROM g),
    dg AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS gram
           FROM dw, lengths, unnest(range(1, len(w) - m + 2)) AS t(i) WHERE len(w) >= m),
    h AS (SELECT dg.doc_id, dg.m, dg.i, g.item_id FROM dg JOIN g USING (m, gram)),
    c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + m)) AS t(p) GROUP BY doc_id),
    n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
)
def _op8(t):
    return decontamination.decontaminate(t.documents, t.benchmark).drop("clean_words")


@query(
    "op10_sharding",
    """
    WITH b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
                      CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
    p AS (SELECT depth, h >> (60 - depth) AS prefix, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows
          FROM b, range(0, 40) AS t(depth) GROUP BY 1, 2),
    f AS (SELECT b.doc_id, b.n_bytes, p.*, row_number() OVER (PARTITION BY b.doc_id ORDER BY p.depth) AS k
          FROM b JOIN p ON b.h >> (60 - p.depth) = p.prefix WHERE p.shard_bytes <= 1048576 OR p.shard_rows = 1)
    SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INTEGER), '0') END AS shard, depth,
           CAST(n_bytes AS BIGINT) AS n_bytes, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_rows
    FROM f WHERE k = 1
    """,
)
def _op10(t):
    return sharding.shard_rows(t.documents)


@query("op9_packing")
def _op9(t):
    path = public_tokenizers.path
    return packing.pack(t.documents, str(path("byte_bpe_50k.json")), str(path("byte_bpe_50k.tiktoken")))


@query("op1_warc")
def _op1(t):
    _, chunks = warc.archive_pages(t.pages)
    return warc.record_table(chunks).withColumnRenamed("record", "page_id")


@query("op3_language_id")
def _op3(t):
    held_out = fold_of(4) == 2
    out = language_id.identify(t.documents, held_out)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op7_toxicity")
def _op7(t):
    held_out = fold_of(5) == 0
    out = toxicity.score(t.documents, t.labels, held_out)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@query(
    "op5_substring_dedup",
    r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    g AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS gram
          FROM w, unnest(range(1, len(w) - 48)) AS t(i) WHERE len(w) >= 50),
    f AS (SELECT gram, min(doc_id) AS low FROM g GROUP BY gram),
    c AS (SELECT DISTINCT doc_id, p FROM g JOIN f USING (gram), unnest(range(i, i + 50)) AS t(p) WHERE low < doc_id),
    e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
    k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS kept, count(*) AS n_kept
          FROM e ANTI JOIN c ON e.doc_id = c.doc_id AND e.p = c.p GROUP BY e.doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM w LEFT JOIN k USING (doc_id)
    """,
)
def _op5(t):
    out = substring_dedup.substring_dedup(t.documents)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_near_dedup")
def _op4(t):
    return near_dedup.near_duplicates(t.documents).drop("key")


@query(
    "op12_filter_audit",
    r"""
    WITH d AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
    f AS (SELECT doc_id, part,
                 CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
                 + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
                 + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
                 + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                 + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS m FROM d),
    c AS (SELECT part, m, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE bad) AS b
          FROM f LEFT JOIN l USING (doc_id) GROUP BY part, m),
    x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(k, bit)),
    o AS (SELECT x1.k || x2.k || x3.k || x4.k || x5.k AS filter_order, [x1.bit, x2.bit, x3.bit, x4.bit, x5.bit] AS bits
          FROM x x1, x x2, x x3, x x4, x x5
          WHERE x1.bit + x2.bit + x3.bit + x4.bit + x5.bit = 31 AND len(list_distinct([x1.k, x2.k, x3.k, x4.k, x5.k])) = 5),
    s AS (SELECT filter_order, i AS step, bits[i] AS bit, CAST(coalesce(list_sum(bits[1 : i - 1]), 0) AS INTEGER) AS before
          FROM o, range(1, 6) AS t(i)),
    r AS (SELECT part, filter_order, step, bit,
                 sum(CASE WHEN m & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
                 sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN n ELSE 0 END) AS removed,
                 sum(CASE WHEN m & before <> 0 AND m & bit <> 0 THEN n ELSE 0 END) AS redundant,
                 sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
                 sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN g ELSE 0 END) AS good_lost,
                 sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN b ELSE 0 END) AS toxic_lost
          FROM c, s GROUP BY part, filter_order, step, bit)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
           CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
    FROM r
    """,
)
def _op12(t):
    return filter_audit.audit(t.documents, t.labels)


@query("op11_token_files")
def _op11(t):
    index = token_files.write_tokens(t.documents, str(public_tokenizers.path("word_bpe_49k.json")))
    return token_files.read_documents(index)


@query("op13_periodic_runs")
def _op13(t):
    found = periodic_runs.periodic_runs(periodic_runs.with_planted_runs(t.documents))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "start",
        "length",
        "period",
        F.floor(1000 * F.col("length") / F.col("period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
