"""Near duplicates, repeated passages, archives and the pipeline against brute force."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from conftest import SMALL
from odd_docs import maker
from pyspark.sql import functions as F

from deedwork.llm import near_dedup, queries, substring_dedup, warc
from deedwork.llm.components import components
from deedwork.session import materialized


@pytest.fixture()
def docs_of(spark):
    return maker(spark)



def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def classes(pairs, least=0.8):
    """Smallest id of each class, by comparing all documents."""
    parent = {i: i for i, _ in pairs}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, (t or "").lower().split(), shingles(t)) for i, t in pairs]
    for k, (i, a, x) in enumerate(sets):
        for j, b, y in sets[:k]:
            if (a and a == b) or (x and y and len(x & y) >= least * len(x | y)):
                one, two = sorted((top(i), top(j)))
                parent[two] = one
    return {i: top(i) for i in parent}


def made(seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(500)]
    pairs, passage = [], [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(80, 300))]
        pairs.append(words)
        for _ in range(rng.randint(0, 8)):
            near = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            pairs.append(near)
        pairs.append([rng.choice(vocabulary) for _ in range(40)] + passage + [rng.choice(vocabulary) for _ in range(40)])
    rng.shuffle(pairs)
    pairs = [(k, " ".join(words)) for k, words in enumerate(pairs)]
    return pairs + [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, "a b c d e f"), (905, "a b c d e f g")]


def test_near_duplicates_are_all_found(docs_of):
    pairs = made()
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs_of(pairs)).collect()}
    want = classes(pairs)
    assert {i: r.class_id for i, r in got.items()} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[want[i]] for i, r in got.items())
    stays = near_dedup.keep_first(docs_of(pairs))
    assert sorted(r.doc_id for r in stays.collect()) == sorted(set(want.values()))


def test_short_near_duplicates_are_all_found(docs_of):
    rng, pairs = random.Random(6), []
    for k in range(300):  # 8 v 9, 9 v 10 and 10 v 11 words, up to 28 v 29
        words = [f"w{k}x{j}" for j in range(rng.choice([9, 10, 11, rng.randint(12, 29)]))]
        pairs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(rng.choice([words[1:], words[:-1]])))]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs_of(pairs)).collect()}
    assert got == classes(pairs) and all(got[2 * k + 1] == 2 * k for k in range(300))


@pytest.mark.parametrize("least", [0.5, 0.8, 0.9])
def test_short_texts_that_match_share_a_key(least):
    rng, linked = random.Random(7), 0
    for _ in range(4000):
        whole = [rng.randrange(1 << 62) for _ in range(rng.randint(1, 40))]
        cut = rng.random() * 0.4
        a, b = (near_dedup._mixed(np.array([x for x in whole if rng.random() > cut], dtype=np.uint64)) for _ in "ab")
        if max(len(a), len(b)) <= near_dedup.EXACT_SHINGLES and near_dedup.aligned(a, b, least) >= least:
            linked += 1
            assert len(np.intersect1d(near_dedup.exact_keys_of(a, least), near_dedup.exact_keys_of(b, least)))
    assert linked > 100


def test_texts_whose_short_hashes_meet_stay_apart(spark, docs_of):
    # Two texts under one id with the same 32-bit hash, looked for among many.
    made_up = spark.range(400_000).select(F.concat(F.lit("one two three four five "), "id").alias("text")).withColumn("h", F.hash("text"))
    one, two = made_up.groupBy("h").agg(F.collect_list("text").alias("t")).where("size(t) > 1").orderBy("h").first().t[:2]
    pairs = [(None, one), (None, two)]
    kept = near_dedup.keep_first(docs_of(pairs), least=0.9).collect()
    assert sorted(r.text for r in kept) == sorted(t for _, t in pairs)
    spans = substring_dedup.substring_dedup(docs_of([(1, one), *pairs]), window=6, gram=3).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in spans) == [("1", 0), ("None", 0), ("None", 6)]


def test_one_row_of_a_class_stays_whatever_its_ids(docs_of):
    words = [f"w{k}" for k in range(40)]
    pairs = [(None, " ".join(words)), (None, " ".join(words[1:])), (None, " ".join(words).upper()), (None, "other")]
    again = [f"v{k}" for k in range(40)]
    pairs += [(7, " ".join(again)), (7, " ".join(again[:-1])), (8, " ".join(again)), (None, None), (3, "")]
    kept = near_dedup.keep_first(docs_of(pairs)).collect()
    assert sorted((str(r.doc_id), (r.text or "")[:1].lower()) for r in kept) == [("3", ""), ("7", "v"), ("None", ""), ("None", "o"), ("None", "w")]


def test_near_duplicates_odd_rows(docs_of):
    text = "one two three four five six seven eight"
    docs = docs_of([(3, text), (3, text), (None, text), (None, ""), (5, "other"), (5, text.upper())])
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted(str((r.doc_id, r.class_id, r.class_size)) for r in got) == sorted(
        map(str, [(3, 3, 4), (3, 3, 4), (None, 3, 4), (5, 3, 4), (None, None, 1), (5, 5, 1)])
    )
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_alignment_needs_the_order():
    words = np.arange(100, dtype=np.uint64)
    a = near_dedup.shingles_of(words)
    assert near_dedup.aligned(a, a) == 1
    assert near_dedup.aligned(a, near_dedup.shingles_of(np.concatenate([words[50:], words[:50]]))) == 0
    assert near_dedup.aligned(a, near_dedup.shingles_of(np.delete(words, 40))) == pytest.approx(91 / 100)
    repeated = near_dedup.shingles_of(np.zeros(50, np.uint64))
    assert len(set(repeated.tolist())) == 46


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 160)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in links:
        one, two = sorted((top(u), top(v)))
        parent[two] = one
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {x: top(x) for x in parent if top(x) != x}


def removed(pairs, window):
    words = [(i, (t or "").split()) for i, t in pairs]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            gram = tuple(w[k : k + window])
            first[gram] = min(first.get(gram, i), i)
    out = {}
    for i, w in words:
        gone = {p for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for p in range(k, k + window)}
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


@pytest.mark.parametrize(("window", "gram"), [(50, 10), (12, 4), (5, 5)])
def test_repeated_passages_by_brute_force(docs_of, window, gram):
    pairs = made(8) + [(906, "la " * 300), (907, "x " + "la " * 100 + "y"), (908, "é " * 49), (909, "é " * 49)]
    got = substring_dedup.substring_dedup(docs_of(pairs), window=window, gram=gram).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == removed(pairs, window)


def test_repeated_passages_odd_rows(docs_of):
    text = " ".join(map(str, range(60)))
    got = substring_dedup.substring_dedup(docs_of([(2, text), (2, text), (None, text), (3, "9 " + text), (4, None)])).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_removed)) for r in got) == sorted(
        map(str, [(2, 60, 0), (2, 60, 0), (None, 60, 60), (3, 61, 60), (4, 0, 0)])
    )
    assert substring_dedup.substring_dedup(docs_of([])).count() == 0


def test_many_equal_rows_under_one_null_id(spark):
    """Rows that repeat id and text are one document to each other, and their spans are gathered once."""
    text = " ".join(f"w{k % 97}x{k}" for k in range(400))
    rows = spark.range(5000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(text).alias("text"))
    docs = rows.unionByName(spark.createDataFrame([(7, text + " end")], "doc_id long, text string"))
    spans = substring_dedup.duplicate_spans(docs.select(F.coalesce("doc_id", F.lit(9)).alias("doc"), F.unhex(F.md5("text")).alias("key"), "text")).collect()
    assert [(r["doc"], r["a"], r["b"]) for r in spans] == [(9, [0], [400])]
    told = substring_dedup.substring_dedup(docs).groupBy("doc_id", "n_words", "n_removed", "kept").count().collect()
    assert sorted((r["n_words"], r["n_removed"], r["count"]) for r in told) == [(400, 400, 5000), (401, 0, 1)]


def test_archives_are_an_exact_round_trip(spark, tmp_path):
    big = "payload é\r\n\r\nWARC/1.1\r\n" * 30_000
    rows = [(1, "http://a", "same"), (5, None, "same"), (3, "http://b/ x\n", "same"), (7, "", None), (8, "u", ""), (9, "u", big), (10, "u", "one")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    index, chunks = warc.archive_pages(pages, str(tmp_path / "a"), archive_bytes=2000, chunk=1000)
    got = {r.record: r for r in warc.record_table(chunks).collect()}
    want = {
        i: (len((t or "").encode()), base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode(), {1: 5, 3: 5, 7: 8}.get(i))
        for i, _, t in rows
    }
    assert {i: (r.payload_bytes, r.payload_digest, r.refers_to) for i, r in got.items()} == want
    assert all(r.record_type == ("revisit" if r.refers_to else "response") for r in got.values())
    parts = sorted((r.chunk_no, bytes(r.chunk), r.bytes_so_far, r.digest_so_far) for r in chunks.where("record = 9").collect())
    assert b"".join(p for _, p, _, _ in parts) == big.encode() and all(len(p) <= 1000 for _, p, _, _ in parts)
    so_far = hashlib.sha1()
    for _, p, n, digest in parts[:20]:
        so_far.update(p)
        assert base64.b32encode(so_far.digest()).decode() == digest
    assert index.select("archive").distinct().count() > 1


def test_archives_odd_cases(spark, tmp_path):
    pages = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (2, "x"), (3, "no")], "page_id long, html string").withColumn("url", F.lit(None))
    _, chunks = warc.archive_pages(pages, str(tmp_path / "b"))
    got = Counter((r.record, r.record_type, r.payload_bytes) for r in warc.record_table(chunks).collect())
    assert got == {(1, "revisit", 1): 2, (-1, "response", 1): 1, (2, "response", 1): 1, (3, "response", 2): 1}
    _, chunks = warc.archive_pages(pages, str(tmp_path / "c"), least_shared_bytes=2)
    assert chunks.where("record_type = 'revisit'").count() == 0
    assert warc.record_table(warc.archive_pages(pages.limit(0), str(tmp_path / "d"))[1]).count() == 0


def test_pipeline_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    with_letters = [r for r in docs if r.text and any(c.isalpha() for c in r.text)]
    groups = defaultdict(list)
    for r in with_letters:
        groups["".join(r.text.encode().decode().split())].append(r)
    kept = [min(g, key=lambda r: (-len(r.text), r.doc_id)) for g in groups.values()]
    label = classes([(r.doc_id, r.text) for r in kept])
    kept = [r for r in kept if label[r.doc_id] == r.doc_id]
    flags = {r.doc_id: r.contaminated for r in queries.QUERIES["op8_decontamination"](spark, SMALL).collect()}
    want = {r.doc_id for r in kept if not flags[r.doc_id]}
    out = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == want
    current = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, current.limit(0), SMALL).columns == current.columns


def test_marks_never_count_more_than_the_difference():
    rng = np.random.default_rng(2)
    for size in (5, 60, 3000):
        a = rng.integers(0, 40, size, dtype=np.uint64)
        b = a.copy()
        b[rng.integers(0, size, size // 20 + 1)] += np.uint64(100)
        x, y = near_dedup.shingles_of(a), near_dedup.shingles_of(b)
        flipped = sum(int(v).bit_count() for v in (near_dedup.marks_of(x) ^ near_dedup.marks_of(y)).view(np.uint64))
        assert flipped <= len(set(x.tolist()) ^ set(y.tolist()))


def test_every_link_of_a_table_is_found(spark):
    """All pairs of documents at 0.8 by brute force, on a whole table."""
    folder = SMALL.replace("sf0.001", "sf0.01")
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = classes(pairs)
    got = {r.doc_id: r.class_id for r in queries.QUERIES["op4_near_dedup"](spark, folder).collect()}
    linked = [i for i in want if want[i] != i]
    assert len(linked) > 50 and len(got) == len(pairs)
    assert all(got[i] == got[want[i]] for i in linked)


def test_the_pipeline_takes_odd_rows(spark, docs_of):
    """Null ids, repeats, no text, extra columns with clashing names: through every stage, each written and read again."""
    tale = " ".join(f"plain{k % 7} words{k}" for k in range(40))
    pairs = [(1, tale), (1, tale), (None, tale), (None, tale + " more"), (2, None), (3, ""), (4, "12 % 34"), (5, "alone and apart from every other text here"), (None, "another text of nobody in particular at all")]
    docs = docs_of(pairs)
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialized(stage(spark, docs, SMALL), f"odd-{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            kept[name] = sorted((str(r.doc_id), r.text) for r in docs.collect())
    assert len(kept["language"]) == 6 and all(any(map(str.isalpha, t)) for _, t in kept["language"])
    assert len(kept["exact"]) == 4 and [t for _, t in kept["exact"]].count(tale) == 1
    assert len(kept["near"]) == len(kept["decontaminated"]) == 3
    assert Counter(str(r.doc_id) for r in docs.collect() if r.start == 0) == Counter(i for i, _ in kept["decontaminated"])


def test_batches_of_near_duplicates_are_bounded_by_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.createDataFrame([(k, f"one text {k % 2} of some more words") for k in range(4)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_dedup.keep_first(docs).collect()) == [0, 1]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == near_dedup.BATCH_BYTES
