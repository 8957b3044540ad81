"""Filter audit, periodic runs and token files against brute force and exact round trips."""

import glob
import hashlib
import random
import zlib
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from conftest import SMALL
from odd_docs import maker
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from deedwork.llm import filter_audit, periodic_runs, queries, token_files
from deedwork.llm.common import split_words

ODD = [
    (3, "a b a b a b a b"),
    (None, "a b a b a b a b"),
    (1, "a b a b a b a b"),
    (1, "a b a b a b a b"),
    (4, None),
    (5, ""),
    (6, " \t\n "),
    (7, "X" * 5000),
    (8, "w " * 3000),
    (9, "é 😀 ½ \x0b tab\x0cfeed | pipe"),
    (10, None),
]


@pytest.fixture()
def docs_of(spark):
    return maker(spark)


def words_of(text):
    return (text or "").encode().split()


def test_words_are_split_alike():
    rng = random.Random(7)
    texts = ["".join(rng.choices(["a", "é", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", "\u2003", "\x00"], k=rng.randint(0, 12))) for _ in range(3000)]
    words, sizes = split_words(pa.array([None, *texts, ""]))
    want = [t.encode().split() for t in ["", *texts, ""]]
    assert sizes.tolist() == list(map(len, want))
    assert words.cast(pa.binary()).to_pylist() == [w for ws in want for w in ws]
    assert split_words(pa.array([], pa.string()))[1].tolist() == []


# --- filter audit


def labels_of(spark, rows=((3, 1, 0), (3, 0, 0), (1, 0, 1), (None, 1, 1), (5, None, None), (7, 1, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def audited(docs, labels):
    """All counts by walking through every order, document by document."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    bad = {i for i, _, t in labels if i is not None and t == 1}
    rows = []
    for i, text, part in docs:
        t, w = text or "", words_of(text)
        fails = set()
        fails |= {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else set()
        fails |= {"D"} if set(t) & set("#$%&*|") else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs) else set()
        rows.append((part or "", fails, i in good, i in bad))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] and bool(r[1] & set(order[: k - 1])) for r in mine)
                told = (len(left), len(gone), redundant, sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone))
                out[part, "".join(order), k] = told
    shapley = {}
    for (part, order, k), told in out.items():
        shapley[part, order[k - 1]] = shapley.get((part, order[k - 1]), 0) + told[1]
    return {(p, o, k): (*told, shapley[p, o[k - 1]]) for (p, o, k), told in out.items()}


def collected(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.collect()}


def test_audit_of_odd_rows_follows_every_order(spark, docs_of):
    docs = docs_of(ODD)
    labels = labels_of(spark)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    want = audited(rows, [tuple(r) for r in labels.collect()])
    assert collected(filter_audit.audit(docs, labels)) == want


def test_audit_of_many_equal_rows(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t "), F.col("id").cast("string"))).alias("text"), F.lit("s").alias("source")
    )
    out = collected(filter_audit.audit(docs, labels_of(spark, [(0, 1, 1)])))
    assert out["s", "EABCD", 1] == (4001, 1999, 0, 0, 0, 0, 1999 * 60)
    assert out["s", "AEBCD", 1][:2] == (0, 6000)


def test_audit_of_no_rows(spark, docs_of):
    docs = docs_of([])
    dictionary, shards = filter_audit.term_matrix(docs)
    assert dictionary.count() == shards.count() == 0
    assert filter_audit.audit(docs, labels_of(spark)).count() == 0


def test_matrix_holds_every_word_count(spark, docs_of):
    docs = docs_of(ODD)
    dictionary, shards = filter_audit.term_matrix(docs)
    words = {r["term"]: bytes(r["word"]) for r in dictionary.collect()}
    assert sorted(words) == list(range(len(words)))
    assert len(set(words.values())) == len(words)
    got = []
    for s in shards.collect():
        indptr, indices, data = np.frombuffer(s["indptr"], "<i8"), np.frombuffer(s["indices"], "<u4").astype(int), np.frombuffer(s["data"], "<u4")
        for k, i in enumerate(s["ids"]):
            part = slice(indptr[k], indptr[k + 1])
            assert (np.diff(indices[part]) > 0).all()
            got.append((str(i), sorted((words[t], n) for t, n in zip(indices[part].tolist(), data[part].tolist(), strict=True))))
    want = [(str(i), sorted((w, words_of(t).count(w)) for w in set(words_of(t)))) for i, t in ODD]
    assert sorted(got) == sorted(want)
    total = {bytes(r["word"]): (r["n_docs"], r["n_words"]) for r in dictionary.collect()}
    assert total[b"a"] == (4, 16)


def test_audit_query_equals_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    rel = con.sql(queries.ORACLES["op12_filter_audit"])
    names = [d[0] for d in rel.description]
    got = queries.QUERIES["op12_filter_audit"](spark, SMALL).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())


# --- periodic runs


def runs_by_hand(w, least_words=6, least_periods=4):
    out = {}
    for p in range(1, len(w) // least_periods + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least_words, least_periods * p):
                out.setdefault((i, j + p), p)
            i = j
    return sorted(((s, e - s, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


def told_by_hand(w):
    runs = runs_by_hand(w)
    drop = {k for s, n, p in runs for k in range(s + p, s + n)}
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    kept = b" ".join(x for k, x in enumerate(w) if k not in drop)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("least_periods", [2, 3, 4])
def test_runs_of_made_up_words(least_periods):
    rng = random.Random(least_periods)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 6)):
            n, k = rng.choice([0, 1, 5, 6, 7, 12, 30, 80, 200]), rng.choice([1, 2, 2, 3, 5])
            w = [rng.randrange(k) for _ in range(n)]
            if n > 20 and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            docs.append(np.array(w, np.int32))
        want = [runs_by_hand(d.tolist(), 6, least_periods) for d in docs]
        assert periodic_runs.runs_of(docs, 6, least_periods) == want


def test_runs_query_against_brute_force(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op13_periodic_runs"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    planted = 0
    for r in docs:
        w, h = words_of(r["text"]), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        assert got[r["doc_id"]] == told_by_hand(w), r["doc_id"]
    assert len(got) == len(docs) and planted > 5


def test_runs_of_odd_rows(spark, docs_of):
    found = periodic_runs.periodic_runs(docs_of(ODD)).collect()
    assert len(found) == len(ODD)
    for text in {t for _, t in ODD}:
        w = words_of(text)
        rows = [r for r in found if r["n_words"] == len(w)]
        assert rows
        for r in rows:
            assert [tuple(x) for x in r["runs"]] == runs_by_hand(w)
    long = next(r for r in found if r["doc_id"] == 8)
    assert (long["start"], long["length"], long["period"], long["collapsed"]) == (0, 3000, 1, "w")
    assert periodic_runs.periodic_runs(docs_of([])).count() == 0
    planted = periodic_runs.with_planted_runs(docs_of(ODD))
    assert planted.count() == len(ODD) and planted.columns == ["doc_id", "text"]


def test_runs_of_one_long_document():
    rng = np.random.default_rng(4)
    block = rng.integers(0, 500, 3001)
    words = np.concatenate([rng.integers(0, 500, 2000), np.tile(block, 9), rng.integers(500, 600, 1500), np.zeros(5000, np.int64)]).astype(np.int32)
    got = periodic_runs.runs_of([words])[0]
    assert (got[0][1], got[0][2]) == (9 * 3001, 3001) and got[-1][1:] == (5000, 1)


# --- token files


def test_words_hold_any_ids():
    rng = np.random.default_rng(1)
    for k in range(100):
        n = int(rng.integers(1, 9000))
        bits = rng.integers(0, 61 if k % 3 else 17, size=n)
        ids = np.where(bits > 0, rng.integers(0, 1 << 60, size=n).astype(np.uint64) >> (60 - np.maximum(bits, 1)).astype(np.uint64), 0).astype(np.uint64)
        ids[: n // 2 * (k % 2)] = 0
        words = token_files.encode(ids)
        assert (token_files.decode(words, n) == ids).all()
    assert len(token_files.encode(np.zeros(480, np.uint64))) == 2
    assert len(token_files.encode(np.full(12, 31, np.uint64))) == 1
    with pytest.raises(ValueError):
        token_files.encode(np.array([1 << 60], np.uint64))


def plain_ids(texts, name="word_bpe_49k.json"):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_token_query_against_the_tokenizer(spark):
    docs = sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()), key=lambda r: r[0])
    want, start = [], 0
    for (i, _), ids in zip(docs, plain_ids([t for _, t in docs]), strict=True):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = queries.QUERIES["op11_token_files"](spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == want


def test_words_encode_like_whole_texts():
    rng = random.Random(2)
    odd = ["a", "Z", "a.", "b,;", ".", "<|ENDOFTEXT|>", "<", "|>", "É", "é", "́", " ", "\t", "\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "　", "'", "s", "ß", "İ", "Σ", "<|endoftext|>", "<|startoftext|>", "1", "½", "漢", "😀", "‍", "\x00", "Ａ", "ﬁ", "-", "#"]
    texts = ["".join(rng.choices(odd, k=rng.randint(0, 30))) for _ in range(5000)]
    encode = token_files._encoder(public_tokenizers.path("word_bpe_49k.json"), True)
    assert [[*ids.tolist(), 1] for ids in encode(pa.array(texts))] == plain_ids(texts)


@pytest.mark.parametrize("by_words", [True, False])
def test_token_files_round_trip(spark, docs_of, tmp_path, by_words):
    name = "word_bpe_49k.json" if by_words else "byte_bpe_50k.json"
    docs = docs_of(ODD)
    index = token_files.write_tokens(docs, public_tokenizers.path(name), str(tmp_path), by_words=by_words, file_ids=500)
    files = index.orderBy("first_id").collect()
    assert len(files) > 2 and sorted(f["path"].rpartition("/")[2] for f in files) == sorted(p.rpartition("/")[2] for p in glob.glob(f"{tmp_path}/*.s8b"))
    got = [tuple(r) for r in token_files.read_documents(index).orderBy("start").collect()]
    order = [i for i, _ in ODD if i is not None]
    assert [r[0] for r in got] == [*sorted(order), None]
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
    want = sorted((i if i is not None else 99, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for (i, _), ids in zip(ODD, plain_ids([t for _, t in ODD], name), strict=True))
    assert sorted((r[0] if r[0] is not None else 99, *r[2:]) for r in got) == want
    assert token_files.read_documents(token_files.write_tokens(docs_of([]), public_tokenizers.path(name), str(tmp_path / "none"))).count() == 0


def test_any_span_of_a_file(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"word{k} and {'again ' * k}") for k in range(300)], "doc_id long, text string").coalesce(1)
    index = token_files.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), str(tmp_path)).collect()
    for f in index:
        file = token_files.TokenFile(f["path"])
        every = file.blocks(0, len(file.offsets) - 1)
        assert len(every) == f["n_ids"] == file.n_ids
        for start, length in ((0, 0), (0, 1), (len(every) - 1, 1), (len(every) // 2, len(every) // 3)):
            assert (file.span(start, length) == every[start : start + length]).all()


def test_one_id_on_many_rows(spark):
    docs = spark.range(4000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = token_files.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    out = token_files.read_documents(index)
    assert index.count() > 1 and out.count() == 4000
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in out.collect())
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_words_of_letters_are_encoded_together_and_kept_within_bounds(monkeypatch):
    monkeypatch.setattr(token_files, "_MEMO_WORDS", 300)
    monkeypatch.setattr(token_files, "_ENCODED_WORDS", 64)
    rng = random.Random(3)
    letters = "abcdeéßİΣ漢"
    # The second half has letters that fold to a letter and a mark, so their words end more often than there are words.
    batches = [[" ".join("".join(rng.choices(letters[: 7 if k < 4 else 10], k=rng.randint(1, 7))) for _ in range(30)) for _ in range(20)] for k in range(8)]
    token_files._encoder.cache_clear()
    encode = token_files._encoder(public_tokenizers.path("word_bpe_49k.json"), True)
    words, calls = encode.__self__, []
    real = words._encoded
    monkeypatch.setattr(words, "_encoded", lambda part: calls.append(len(part)) or real(part))
    for k, texts in enumerate(batches):
        assert [[*ids.tolist(), 1] for ids in encode(pa.array(texts))] == plain_ids(texts)
        assert len(words.known) == len(words.sizes) == len(words.starts) <= 600 and sum(words.sizes) == len(words.flat)
        assert (len(calls) > 0) == (k >= 4)
    token_files._encoder.cache_clear()
