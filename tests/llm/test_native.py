"""Operators in DataFrame functions: against SQL on the tables, brute force on small documents, and the odd cases."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from conftest import SMALL
from odd_docs import maker
from oracle_check import compare, connect
from pyspark.sql import functions as F

from deedwork.llm import decontamination, exact_dedup, line_dedup, queries, sharding

ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (None, "x y"),
    (4, "xy"),
    (5, "x  y"),
    (5, "x  y"),
    (6, "É a é"),
    (7, "lorem ipsum " * 3000),
    (8, "lorem ipsum" * 3000),
    (9, "lorem ipsum" * 3000 + "!"),
    (None, None),
]
PYTHON = ("PythonUDF", "InPandas", "InArrow", "ExistingRDD", "CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture()
def docs_of(spark):
    return maker(spark)



@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, duck, name):
    ok, message = compare(queries.QUERIES[name](spark, SMALL), duck, queries.ORACLES[name])
    assert ok, message


@pytest.mark.parametrize("name", ["op6_exact_dedup", "op8_decontamination", "op10_sharding"])
def test_native_plans_have_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not [shape for shape in PYTHON if shape in plan]


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


@pytest.mark.parametrize("digest", [exact_dedup.block_digest, lambda b: F.crc32(b) % 3], ids=["digest", "colliding"])
def test_exact_dedup_by_brute_force(docs_of, digest):
    groups = defaultdict(list)
    for i, t in ODD:
        groups[squeezed(t)].append((i, t))
    got = exact_dedup.exact_dedup(docs_of(ODD), block_chars=7, digest=digest).collect()
    assert len(got) == len(ODD)
    kept = Counter()
    for r in got:
        alike = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        best = min(alike, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
        assert (r.keep_id, r.group_size) == (best[0], len(alike))
        kept[r.text_sha256] += r.kept
    assert len(kept) == len(groups) and set(kept.values()) == {1}


def test_exact_dedup_keeps_whole_rows(docs_of):
    docs = docs_of(ODD)
    rest = exact_dedup.keep_one(docs)
    assert rest.columns == docs.columns
    assert sorted(squeezed(r.text) for r in rest.collect()) == sorted({squeezed(t) for _, t in ODD})
    assert exact_dedup.keep_one(docs.limit(0)).count() == 0


def test_line_dedup_by_brute_force(docs_of):
    common = "This very line stands in a great many documents."
    pairs = [(k, f"{k}\n  {common.upper() if k % 2 else common}\t\r\nshort\n\n") for k in range(6)]
    pairs += [(None, common), (6, None), (7, ""), (8, "short"), (9, "\n" + common + "É"), (5, common + "\n" + common)]
    got = line_dedup.line_dedup(docs_of(pairs)).collect()
    want = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if x.strip(" \t\n\x0b\x0c\r").lower() != common.lower() or i == 5]
        want.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_lines, r.n_dropped, r.kept)) for r in got)
    assert line_dedup.line_dedup(docs_of([])).count() == 0


def test_decontamination_by_brute_force(spark, docs_of):
    item = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame(
        [(1, item), (2, "Élan"), (3, None), (4, "--"), (5, "tiny item"), (None, "tiny item")], "item_id long, text string"
    )
    pairs = [
        (1, f"before {item.upper()}, after"),
        (2, "before " + " ".join(item.split()[1:11]) + " after tiny; ITEM"),
        (3, " ".join(item.split()[:9])),
        (4, "élan Élan"),
        (5, None),
        (6, ""),
        (None, "tiny tiny item item"),
        (7, "a " * 5000 + item),
    ]
    got = {r.doc_id: r for r in decontamination.decontaminate(docs_of(pairs), items).collect()}
    assert {k: (r.n_words, r.n_hit, r.n_items) for k, r in got.items()} == {
        1: (14, 12, 1),
        2: (14, 12, 2),
        3: (9, 0, 0),
        4: (2, 1, 1),
        5: (0, 0, 0),
        6: (0, 0, 0),
        None: (4, 2, 1),
        7: (5012, 12, 1),
    }
    assert got[2].items_sha256 == hashlib.sha256(b"1,5").hexdigest() and got[2].clean_words == "before after"
    clean = decontamination.clean_documents(docs_of(pairs), items)
    assert sorted(r.doc_id for r in clean.collect()) == [3, 5, 6] and clean.columns == docs_of(pairs).columns
    assert decontamination.decontaminate(docs_of(pairs), items.limit(0)).where("contaminated").count() == 0
    assert decontamination.decontaminate(docs_of([]), items).count() == 0


def test_shards_fit_and_hot_keys_split(docs_of):
    pairs = [(7 if k % 3 else k, "x" * 50) for k in range(300)] + [(500, "y" * 5000), (None, None), (None, "z"), (501, "")]
    rows = sharding.shard_rows(docs_of(pairs), limit=1000).collect()
    assert len(rows) == len(pairs)
    sums, counts, names = Counter(), Counter(), {r.shard for r in rows}
    for r in rows:
        sums[r.shard] += r.n_bytes
        counts[r.shard] += 1
        assert len(r.shard) == r.depth
    assert all(sums[r.shard] == r.shard_bytes and counts[r.shard] == r.shard_rows for r in rows)
    assert all(v <= 1000 or counts[k] == 1 for k, v in sums.items())
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    assert sharding.shard_rows(docs_of([])).count() == 0
    assert {r.shard for r in sharding.shard_rows(docs_of(pairs), limit=10**6).collect()} == {""}
