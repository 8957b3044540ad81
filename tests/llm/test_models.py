"""Trained scorers and packing: held-out accuracy, exact code lengths, exact round trips."""

import functools
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from conftest import SMALL
from odd_docs import maker
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from deedwork.llm import language_id, packing, queries, toxicity

JSON, RANKS = (str(public_tokenizers.path(f"byte_bpe_50k.{x}")) for x in ("json", "tiktoken"))


@pytest.fixture()
def docs_of(spark):
    return maker(spark)



def test_code_lengths_are_those_of_ppm():
    counts = Counter()
    for word in (b" ab", b" ab", b" abc"):
        for end in range(2, len(word) + 1):
            for start in range(max(0, end - 5), end):
                counts["en", word[start:end]] += 1
    trees = language_id.ContextTrees([(lang, gram, n) for (lang, gram), n in counts.items()])
    # " a" and " ab" were seen by themselves; "x" escapes from three contexts, and then is one byte of 256.
    seen = sum(n for (_, g), n in counts.items() if len(g) == 1)
    want = -math.log2(3 / 4) - math.log2(3 / 4) + 2 * math.log2(2) + math.log2(2) + math.log2((seen + 3) / 3) + 8
    got = trees.texts(pa.array(["abx", "abx  ab\n", None, " "]))[:, 0]
    assert got.tolist() == pytest.approx([want, want + 2 * math.log2(4 / 3), 0, 0])


def ppm_by_hand(docs):
    """Language and posterior of every text by the definition, byte by byte; all labelled documents outside the fold are learned."""
    counts = defaultdict(Counter)
    for i, text, lang in docs:
        if lang is not None and text is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            for word in text.encode().split():
                padded = b" " + word
                for end in range(2, len(padded) + 1):
                    for size in range(1, min(5, end) + 1):
                        counts[lang, padded[end - size : end - 1]][padded[end - 1 : end]] += 1
    langs, known = sorted({lang for lang, _ in counts}), {}

    def bits(lang, word):
        if (lang, word) not in known:
            total, padded = 0.0, b" " + word
            for end in range(2, len(padded) + 1):
                for size in range(min(5, end), 0, -1):
                    seen = counts.get((lang, padded[end - size : end - 1]))
                    if seen:
                        all_, kinds, n = sum(seen.values()), len(seen), seen[padded[end - 1 : end]]
                        total += math.log2((all_ + kinds) / (n or kinds))
                        if n:
                            break
                else:
                    total += 8
            known[lang, word] = total
        return known[lang, word]

    for i, text, _ in docs:
        if not text or not any(map(str.isalpha, text)):
            yield i, "und", 0.0
            continue
        lengths = [sum(bits(lang, w) for w in text.encode().split()) for lang in langs]
        best = lengths.index(min(lengths))
        yield i, langs[best], 1 / sum(2.0 ** max(lengths[best] - x, -1000) for x in lengths)


def test_language_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()]
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.QUERIES["op3_language_id"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    for i, lang, score in ppm_by_hand(docs):
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, rel=1e-6)


def test_what_has_no_letter_has_no_language(docs_of):
    texts = ["½", "²³", "Ⅷ", "12 _ %", "٣", "x²", "漢", "½ é"]
    docs = docs_of([*enumerate(texts), (100, "plain words")])
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, F.lit(False)).collect()}
    assert {i for i, lang in got.items() if lang == "und"} == {i for i, t in enumerate(texts) if not any(map(str.isalpha, t))} == {0, 1, 2, 3, 4}


def test_language_is_told_for_held_out_documents(spark):
    got = queries.QUERIES["op3_language_id"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.where("lang is not null").collect()
    for part in (True, False):
        told = [r.lang == r.lang_pred for r in rows if r.held_out is part]
        assert told and sum(told) / len(told) >= 0.95
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_language_odd_cases(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "12 %"), (4, "plain words"), (4, "plain words"), (None, "plain"), (5, "word " * 50_000)])
    got = language_id.identify(docs, F.lit(False), keep=("text", "key"))
    assert got.columns == ["doc_id", "text", "key", "lang_pred", "score"]
    assert Counter(r.lang_pred for r in got.collect()) == {"und": 3, "en": 4}
    assert language_id.identify(docs.limit(0), F.lit(False)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, F.lit(True)).collect()} == {"und"}


def test_a_language_of_long_documents_only_is_learned(spark):
    rows = [(i, "the plain words of a tale " * 3, "en") for i in range(5)] + [(i, "das schöne wörterbuch " * 3000, "de") for i in range(5, 10)]
    docs = spark.createDataFrame([*rows, (20, "schöne wörterbuch", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, F.lit(False)).collect()}
    assert got == {i: lang or "de" for i, _, lang in rows} | {20: "de"}



def words_by_hand(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def spelled_by_hand(word):
    marked = "\x02" + word + "\x03"
    return [marked[max(0, k - 3) : k + 1] for k in range(1, len(marked))]


class Models:
    """Both classes and their shared backoff, by the definition; ``counts``: gram -> (ordinary count, toxic count)."""

    def __init__(self, counts):
        self.own = [{g: n[c] for g, n in counts.items() if n[c]} for c in (0, 1)]
        self.shared, longer = Counter(), set(counts)
        while longer:  # a shorter sequence counts once for each sequence that it ends
            self.shared.update(g[1:] for g in longer if len(g) > 1)
            longer = {g[1:] for g in longer if len(g) > 1}
        self.after = [self.followers(n) for n in (*self.own, self.shared)]
        self.characters = 1 + sum(len(g) == 1 for g in self.shared)

    @staticmethod
    def followers(counts):
        out = defaultdict(list)
        for gram, n in counts.items():
            out[gram[:-1]].append(n)
        return out

    def mixed(self, counts, after, gram, shorter):
        if gram[:-1] not in after:
            return shorter
        every = after[gram[:-1]]
        return (max(counts.get(gram, 0) - 0.75, 0) + 0.75 * len(every) * shorter) / sum(every)

    @functools.cache
    def backoff(self, gram):
        return self.mixed(self.shared, self.after[2], gram, self.backoff(gram[1:])) if gram else 1 / self.characters

    @functools.cache
    def evidence(self, gram):
        ordinary, toxic = (self.mixed(self.own[c], self.after[c], gram, self.backoff(gram[1:])) for c in (0, 1))
        return math.log(toxic / ordinary)

    def word(self, word):
        return sum(map(self.evidence, spelled_by_hand(word)))

    def text(self, text):
        """Mean evidence of a character, each word's end being one, and the peak."""
        words = words_by_hand(text)
        if not words:
            return 0.0, 0.0
        told = [self.word(w) for w in words]
        ratio = math.log(sum(math.exp(e - max(told)) for e in told) / len(told)) + max(told)
        return sum(told) / sum(len(w) + 1 for w in words), math.asinh(5 * min(ratio, 8.0))


def grams_by_hand(pairs):
    counts = defaultdict(lambda: [0, 0])
    for text, label in pairs:
        for gram in (g for word in words_by_hand(text) for g in spelled_by_hand(word)):
            counts[gram][label] += 1
    return counts


def in_curve(spark, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    return {r.id for r in rows.where(F.pmod(F.xxhash64(F.lit("curve"), F.col("id").cast("string")), F.lit(toxicity.SLICES)) == 0).collect()}


def test_toxic_documents_are_told_when_held_out(spark):
    insults = "idiot moron trash".split()
    plain = "the quick brown fox jumps over a lazy dog near some river bank".split()
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(plain, rng.integers(5, 300)))
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            words.insert(rng.integers(0, len(words)), rng.choice(insults))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "trash"), (1002, "1 2 3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1), (7, None), (8, 3)], "doc_id long, toxic int")
    got = toxicity.score(docs, known, F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(truth[r.doc_id] == r.predicted for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id in (1000, 1001, 1002))
    assert toxicity.score(docs, known.limit(0), F.lit(False)).where("evidence <> 0").count() == 0
    assert toxicity.score(docs.limit(0), known, F.lit(False)).count() == 0


def test_all_words_tell_of_a_document_whatever_its_length(spark):
    models = Models({"\x02a": (9, 1), "a\x03": (1, 1), "\x02b": (1, 9), "b\x03": (1, 1)})
    for word in "ab":
        assert models.text(word) == pytest.approx(models.text(" ".join([word] * 50)))
    assert models.text("b") > models.text("b" + " a" * 5) > models.text("b" + " a" * 50)
    # Toxicity that lies in no single word: each is only somewhat more frequent in one class.
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    tilt = np.where(np.arange(60) < 30, 2.0, 1.0)
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(100, 600), p=(w := tilt[:: 1 if i % 2 else -1]) / w.sum()))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    told = [r.predicted == r.doc_id % 2 for r in toxicity.score(docs, labels, held).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(told) >= 0.95 * len(told)


def test_every_sequence_counts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_GRAMS", 50, raising=False)  # a bound that once cut the counts
    rng = np.random.default_rng(5)
    rows = [(i, " ".join("".join(rng.choice(list("abcdeé日"), rng.integers(1, 8))) for _ in range(rng.integers(0, 30)))) for i in range(200)]
    docs = spark.createDataFrame([*rows, (None, "abc xyz"), ((1 << 62) + 1, "cab")], "doc_id long, text string").repartition(3)
    labels = {i: int(i % 3 == 0) for i, _ in rows}
    curve = in_curve(spark, labels)
    models = Models(grams_by_hand((text, labels[i]) for i, text in rows if i not in curve))
    got = toxicity.score(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"), F.lit(False)).collect()
    want = {i: models.text(text)[0] for i, text in [*rows, (None, "abc xyz"), ((1 << 62) + 1, "cab")]}
    assert len(got) == len(want) and {r.doc_id: r.evidence for r in got} == pytest.approx(want)


def test_backoff_is_a_distribution():
    counts = Counter()
    for word in ("aba", "abb", "b"):
        counts.update(spelled_by_hand(word))
    models = Models({g: (n, n % 2) for g, n in counts.items()})
    letters = [g for g in models.shared if len(g) == 1]
    for context in ("", "a", "ab", "b", "\x02a"):
        assert sum(models.backoff(context + x) for x in letters) == pytest.approx(1, abs=0.35)


def with_insults(spark, size):
    """The labelled documents of a table, and texts of insults and ordinary words beside them."""
    folder = SMALL.replace("sf0.001", size)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").join(labels, "doc_id", "left_semi")
    ordinary = docs.join(labels.where("toxic = 0"), "doc_id", "left_semi").where("length(text) > 2000").orderBy("doc_id").first()
    plain = words_by_hand(ordinary.text)[:15]
    added = {0: "", 1: "idiot", 2: "idiot " * 6, 3: "trash idiot " * 60, 4: " ".join(plain * 7), 5: " ".join(plain * 7 + ["idiot"])}
    for n in range(8):
        added[10 + n] = " ".join(["trash", "idiot", "loser", "moron", "stupid", "clown", "scum"][:n] + plain * 3)
    added |= {30 + n: " ".join(["trash", "loser"][:1] + ["loser"] * n) for n in range(5)}
    extra = [((1 << 40) + k, text) for k, text in added.items()]
    return docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string")), labels


def test_an_insult_never_lowers_a_score(spark):
    docs, labels = with_insults(spark, "sf0.1")
    got = toxicity.score(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    told = {r.doc_id - (1 << 40): r.score for r in got.where(F.col("doc_id") >= 1 << 40).collect()}
    assert min(told[k] for k in (1, 2, 3)) > 0.9 and told[5] > 0.5
    assert told[0] < 0.11 and told[4] < 0.11 and told[5] > told[4]
    assert all(told[11 + n] >= told[10 + n] for n in range(7)) and told[11] > told[10]
    assert all(told[31 + n] >= told[30 + n] for n in range(4))


def test_whole_score_against_brute_force(spark):
    """Counts, backoff, both measures and the curve, each by its definition; the library fits the curve to bins, this one to every document."""
    docs, labels = with_insults(spark, "sf0.01")
    texts, known = dict(map(tuple, docs.collect())), {r.doc_id: r.toxic for r in labels.collect() if r.toxic in (0, 1)}
    free = [i for i in texts if i in known and zlib.crc32(str(i).encode()) % 5]
    curve = in_curve(spark, free)
    models = Models(grams_by_hand((texts[i], known[i]) for i in free if i not in curve))
    measured = {i: models.text(t) for i, t in texts.items()}
    x = np.array([[20 * min(measured[i][0], 1.0), measured[i][1], 1] for i in free if i in curve])
    y = np.array([known[i] for i in free if i in curve])
    w = np.zeros(3)
    for _ in range(20_000):  # projected gradient: slopes stay at 0 or above
        w += 0.5 / len(y) * (x.T @ (y - 1 / (1 + np.exp(-x @ w))) - 1e-3 * w)
        w[:2] = np.maximum(w[:2], 0)
    got = {r.doc_id: r for r in toxicity.score(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()}
    assert len(got) == len(texts)
    for i, (mean, peak) in measured.items():
        assert got[i].evidence == pytest.approx(mean, abs=1e-9)
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-(w[0] * 20 * min(mean, 1.0) + w[1] * peak + w[2]))), abs=0.03)


def test_toxicity_with_clashing_names_and_many_equal_rows(spark, docs_of):
    rows = [(k, "idiot trash" if k % 3 == 0 else "a plain text") for k in range(30)] + [(None, "a plain text")] * 200 + [(5, "idiot trash")] * 200
    docs = docs_of(rows)
    labels = spark.createDataFrame([(k, int(k % 3 == 0), k) for k in range(30)], "doc_id long, toxic int, gram int")
    got = toxicity.score(docs, labels, F.lit(False)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert len({r.score for r in got}) == 2


def check_pieces(rows, ids, seq):
    seen, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        seen[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        windows[r.sequence_id].append((r.offset, r.length))
    todo = defaultdict(list)
    for i, x in ids:
        todo[i].append(x)
    for i, texts in todo.items():
        assert sum(p[1] for p in seen[i]) == sum(map(len, texts))
        for x in {t.tobytes(): t for t in texts}.values():
            mine = sorted(p for p in set(seen[i]) if p[3] == len(x) and p[2] == zlib.crc32(x[p[0] : p[0] + p[1]].tobytes()))
            assert mine
    for sequence in windows.values():
        at = 0
        for offset, length in sorted(sequence):
            assert offset == at and length > 0
            at += length
        assert at <= seq
    full = sorted(sum(n for _, n in w) for w in windows.values())
    assert full[1:] == [seq] * (len(full) - 1)
    assert sorted(windows) == list(range(len(windows)))


def encoded(pairs):
    plain = Tokenizer.from_file(JSON)
    return [(i, np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in pairs]


def test_packing_is_an_exact_round_trip(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check_pieces(queries.QUERIES["op9_packing"](spark, SMALL).collect(), encoded([(r.doc_id, r.text) for r in docs.collect()]), 2048)


@pytest.mark.parametrize("ranks", [RANKS, ""])
def test_packing_odd_cases(docs_of, ranks):
    pairs = [(1, None), (2, ""), (None, "a b"), (3, "same"), (3, "same"), (4, "x <|endoftext|> y"), (5, "long words \n " * 4000), (6, "é　 日本  x")]
    rows = packing.pack(docs_of(pairs), JSON, ranks, seq_tokens=64).collect()
    check_pieces(rows, encoded(pairs), 64)
    assert packing.pack(docs_of([]), JSON, ranks).count() == 0


def test_windows_keep_the_mixture(spark):
    rows = [(i, "word " * (10 + i % 90), "abc"[min(i % 7, 2)]) for i in range(300)] + [(1000, "tiny", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    total, mix = Counter(), defaultdict(Counter)
    source = {i: s for i, _, s in rows}
    for r in packing.pack(docs, JSON, RANKS, seq_tokens=256).collect():
        total[source[r.doc_id]] += r.length
        mix[r.sequence_id][source[r.doc_id]] += r.length
    every = sum(total.values())
    for window in sorted(mix)[:-1]:
        for s in "abc":
            assert abs(mix[window][s] - 256 * total[s] / every) <= 6


def served(sizes, weights, seq):
    """Deficit round-robin as a loop over windows, exact credits carried: tokens of each queue in each window."""
    left, out = list(sizes), []
    credit, before, held = [Fraction(0)] * len(sizes), [0] * len(sizes), []
    while any(left):
        if not held:  # shares stay as they are until a queue cannot give its due
            held = [w if n else 0 for w, n in zip(weights, left, strict=True)]
            held = held if any(held) else list(left)
        credit = [c + Fraction(seq * w, sum(held)) for c, w in zip(credit, held, strict=True)]
        upto = [math.floor(sum(credit[: q + 1], Fraction(0))) for q in range(len(sizes))]
        total = [a - b for a, b in zip(upto, [0, *upto], strict=False)]
        due = [a - b for a, b in zip(total, before, strict=True)]
        before = total
        if sum(left) >= seq and all(d <= n for d, n in zip(due, left, strict=True)):
            own = due
        else:
            own = [min(n, max(0, d)) for n, d in zip(left, due, strict=True)]
            while sum(own) < min(seq, sum(left)):
                lack = min(seq, sum(left)) - sum(own)
                able = [q for q in range(len(left)) if left[q] > own[q]]
                able = [q for q in able if held[q]] or able
                share = sum(held[q] or 1 for q in able)
                more = {q: min(left[q] - own[q], lack * (held[q] or 1) // share) for q in able}
                if not any(more.values()):
                    more = dict.fromkeys(sorted(able, key=lambda q: (-held[q], q))[:lack], 1)
                own = [n + more.get(q, 0) for q, n in enumerate(own)]
            credit, before, held = [Fraction(0)] * len(sizes), [0] * len(sizes), []
        left = [n - x for n, x in zip(left, own, strict=True)]
        out.append(own)
    return out


def test_the_schedule_is_deficit_round_robin():
    rng = np.random.default_rng(6)
    for _ in range(300):
        queues, seq = int(rng.integers(1, 6)), int(rng.choice([8, 20, 64]))
        sizes = [int(n) for n in rng.integers(0, 600, queues)]
        weights = [int(w) for w in rng.integers(1, 9, queues)] if rng.random() < 0.7 else list(sizes)
        weights = [w if w * seq >= sum(weights) else 0 for w in weights]
        got, want = [], served(sizes, weights, seq)
        for s in packing.schedule(sizes, weights, seq):
            assert s.first == len(got)
            for n in range(s.windows):
                upto = [s.upto(q, n + 1, seq) - s.upto(q, n, seq) for q in range(queues + 1)]
                got.append([b - a for a, b in zip(upto, upto[1:], strict=False)])
        assert got == want


def test_windows_keep_given_targets(spark):
    rows = [(i, "word " * (10 + i % 90), "abcd"[i % 4]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    targets = {"a": 0.6, "b": 0.3, "c": 0.1, "absent": 0.5}
    pieces = packing.pack(docs, JSON, RANKS, seq_tokens=256, targets=targets).collect()
    check_pieces(pieces, encoded([r[:2] for r in rows]), 256)
    source, mix = {i: s for i, _, s in rows}, defaultdict(Counter)
    for r in pieces:
        mix[r.sequence_id][source[r.doc_id]] += r.length
    total = Counter(source[r.doc_id] for r in pieces for _ in range(r.length))
    want = served([total[s] for s in "abcd"], [6, 3, 1, 0], 256)
    assert [[mix[w][s] for s in "abcd"] for w in range(len(want))] == want and len(mix) == len(want)
    with pytest.raises(ValueError, match="under one token"):
        packing.pack(docs, JSON, RANKS, seq_tokens=256, targets={"a": 1, "b": 0.001})
