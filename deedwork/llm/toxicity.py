"""Toxicity by class-conditional Kneser-Ney models.

Words are spelled by two character models, one of toxic and one of ordinary documents, of ``ORDER`` characters within a word. Each discounts its
own counts; what it saves goes to one backoff model that both share, whose counts are the distinct contexts a character sequence continues. A rare
expression is therefore told by what is known of its parts, and one unknown to both classes speaks for neither.

A word's evidence is the difference of its log-likelihoods, toxic less ordinary. All words of a document count, in two length-normalised ways: the mean
evidence of a character, and the peak, the logarithm of the mean likelihood ratio of a word, which one telling word among N raises by its evidence less
log N; it is read on the scale of ``asinh``. A logistic curve of both makes a score; it is fitted to a histogram of the training documents whose id
hashes into one of ``SLICES`` slices, which are not counted, so that it sees the evidence of new documents. More evidence never counts against toxicity: no slope
is negative, and both measures are level from ``MEAN_TOP`` and ``PEAK_TOP`` on. So a word with that much evidence never lowers a score, wherever it is added.

Counts cover all other labelled training rows and none is left out. They, the backoff and the evidence of a sequence are tables. Texts are written as
blocks of word counts; each block asks for its distinct sequences once and meets their evidence by a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedwork.llm.common import fold, materialized, python_ready

ORDER = 4
DISCOUNT = 0.75
SLICES = 6
MEAN_BIN, MEAN_BINS = 0.0025, 800
PEAK_BIN, PEAK_BINS = 0.05, 400
MEAN_SCALE = 20.0
MEAN_TOP, PEAK_TOP = 1.0, 8.0
PEAK_SCALE = 5.0
BLOCK_CHARACTERS = 4_000_000
_MEMO_WORDS = 500_000
_START, _END = "\x02", "\x03"
_WORD = re.compile(r"[^\W\d_]+")


def _words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _spelled(word: str) -> Iterator[str]:
    """Each character of a word and its end, with the characters before."""
    marked = _START + word + _END
    return (marked[max(0, end - ORDER) : end] for end in range(2, len(marked) + 1))


def _weighed(told: np.ndarray, times: np.ndarray, lengths: np.ndarray) -> tuple[float, float]:
    """Mean and peak of words with this evidence, so many times each."""
    top = told.max()
    ratio = top + np.log((times * np.exp(told - top)).sum() / times.sum())
    mean = (times * told).sum() / (times * (lengths + 1)).sum()
    return float(mean), float(np.arcsinh(PEAK_SCALE * min(ratio, PEAK_TOP)))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words: tuple[Counter, Counter] = (Counter(), Counter())

    def grams() -> pd.DataFrame:
        sums: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for c in (0, 1):
            for word, n in words[c].items():
                for gram in _spelled(word):
                    sums[gram][c] += n
            words[c].clear()
        return pd.DataFrame([(g, *n) for g, n in sums.items()], columns=["gram", "ordinary", "toxic"])

    for batch in batches:
        for label, text in zip(batch["label"], batch["text"], strict=True):
            words[label].update(_words(text))
        if len(words[0]) + len(words[1]) > _MEMO_WORDS:
            yield grams()
    yield grams()


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in blocks: ids, the distinct words, and for each row its number of words, their places among these and how often each occurs."""

    def block(part: pd.DataFrame) -> pd.DataFrame:
        place: dict[str, int] = {}
        ends, steps, times = [], [], []
        for text in part["text"]:
            at = np.array([place.setdefault(word, len(place)) for word in _words(text)], dtype=np.int64)
            known, n = np.unique(at, return_counts=True)
            ends.append(len(known))
            steps.append(np.diff(known, prepend=0))
            times.append(n)
        packed = [zlib.compress(np.concatenate(x).astype("<u4").tobytes(), 1) for x in (steps, times)]
        words = zlib.compress("\n".join(place).encode("utf-8", "surrogatepass"), 1)
        row = {"ids": part["id"].tolist(), "held": part["held"].tolist(), "sizes": ends, "words": words, "steps": packed[0], "times": packed[1]}
        return pd.DataFrame([row])

    for batch in batches:
        turns = batch["text"].str.len().fillna(0).cumsum().floordiv(BLOCK_CHARACTERS)
        for _, part in batch.groupby(turns.to_numpy()):
            yield block(part)


def _unpacked(words: bytes) -> list[str]:
    text = zlib.decompress(words).decode("utf-8", "surrogatepass")
    return text.split("\n") if text else []


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for block, words in zip(batch["block"], batch["words"], strict=True):
            yield pd.DataFrame({"block": block, "gram": sorted({g for word in _unpacked(words) for g in _spelled(word)})}).astype({"gram": str})


def _judge(blocks: pd.DataFrame, grams: pd.DataFrame) -> pd.DataFrame:
    known = dict(zip(grams["gram"], grams["told"], strict=True))
    rows = []
    for r in blocks.itertuples():
        words = _unpacked(r.words)
        told = np.array([sum(known[g] for g in _spelled(word)) for word in words])
        lengths = np.array([len(word) for word in words], dtype=np.float64)
        steps, times = (np.frombuffer(zlib.decompress(x), "<u4").astype(np.int64) for x in (r.steps, r.times))
        end = 0
        for row_id, held, size in zip(r.ids, r.held, r.sizes, strict=True):
            start, end = end, end + size
            at = np.cumsum(steps[start:end])
            rows.append((row_id, held, *(_weighed(told[at], times[start:end], lengths[at]) if size else (0.0, 0.0))))
    return pd.DataFrame(rows, columns=["id", "held", "mean", "peak"])


_CONTEXT, _SHORTER = "substring(gram, 1, length(gram) - 1)", "substring(gram, 2)"


def _mixed(n: str, total: str, kinds: str, shorter: str) -> str:
    return f"if(coalesce({kinds}, 0) = 0, {shorter}, (greatest(coalesce({n}, 0) - {DISCOUNT}D, 0D) + {DISCOUNT}D * {kinds} * {shorter}) / {total})"


def evidence_of(counts: DataFrame, grams: DataFrame) -> DataFrame:
    """``gram`` and ``told``, log P(toxic) - log P(ordinary) of its last character, of the distinct ``grams``; ``counts``: gram, ordinary, toxic."""
    level, parts = counts.select("gram"), []
    for _ in range(ORDER - 1):
        parts.append(level.where("length(gram) > 1").selectExpr(f"{_SHORTER} as gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
        level = parts[-1].select("gram")
    shared = parts[0]
    for part in parts[1:]:
        shared = shared.unionByName(part)
    shared = materialized(shared.groupBy("gram").agg(F.sum("n").alias("n")), "toxic-backoff")
    characters = 1 + shared.where("length(gram) = 1").count()
    left = shared.groupBy(F.expr(_CONTEXT).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))

    ends = [grams.selectExpr(f"substring(gram, {k}) as gram").where("gram <> ''") for k in range(2, ORDER + 1)]
    every = ends[0]
    for more in ends[1:]:
        every = every.unionByName(more)
    every = every.distinct().join(shared, "gram", "left").withColumn("context", F.expr(_CONTEXT)).join(left, "context", "left")
    every = materialized(every.select("gram", "n", "total", "kinds"), "toxic-suffixes")
    backoff = last = every.where("length(gram) = 1").selectExpr("gram", f"{_mixed('n', 'total', 'kinds', f'{1 / characters!r}D')} as p")
    for size in range(2, ORDER):
        longer = every.where(f"length(gram) = {size}").withColumn("end", F.expr(_SHORTER))
        last = longer.join(last.selectExpr("gram as end", "p as shorter"), "end").selectExpr("gram", f"{_mixed('n', 'total', 'kinds', 'shorter')} as p")
        backoff = backoff.unionByName(last)
    backoff = materialized(backoff, "toxic-shorter")

    sums = [f(c).alias(f"{c}_{what}") for c in ("ordinary", "toxic") for what, f in (("total", F.sum), ("kinds", lambda c: F.count_if(F.col(c) > 0)))]
    own = counts.groupBy(F.expr(_CONTEXT).alias("context")).agg(*sums)
    both = grams.selectExpr("gram", f"{_CONTEXT} as context", f"{_SHORTER} as end").join(backoff.selectExpr("gram as end", "p as shorter"), "end")
    both = both.join(counts, "gram", "left").join(own, "context", "left")
    toxic, ordinary = (_mixed(c, f"{c}_total", f"{c}_kinds", "shorter") for c in ("toxic", "ordinary"))
    return both.selectExpr("gram", f"ln(({toxic}) / ({ordinary})) as told")


def _logistic(bins: list[tuple[int, int, int, int]]) -> tuple[float, float, float]:
    """(slope of the mean, slope of the peak, offset) of P(toxic) from (mean bin, peak bin, ordinary, toxic), by Newton's method with a little shrinkage.

    A slope that would be negative is 0, and the others are fitted without it.
    """
    table = np.array(bins, dtype=np.float64).reshape(-1, 4)
    total, hits = table[:, 2] + table[:, 3], table[:, 3]
    if not hits.sum() or hits.sum() == total.sum():
        return 1.0, 1.0, -2.0
    scale = np.array([MEAN_SCALE, 1.0, 1.0])
    features = np.column_stack([table[:, :2] * [MEAN_BIN, PEAK_BIN], np.ones(len(table))]) * scale
    used = [0, 1, 2]
    while True:
        w = np.zeros(3)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
            slope = (features.T @ (hits - total * p) - 1e-3 * w)[used]
            bend = ((features * (total * p * (1 - p))[:, None]).T @ features + 1e-3 * np.eye(3))[np.ix_(used, used)]
            step = np.linalg.solve(bend, slope)
            w[used] += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        least = min(used[:-1], key=lambda k: w[k], default=2)
        if least == 2 or w[least] >= 0:
            return tuple((w * scale).tolist())
        used.remove(least)


def score(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """One row per input row: ``id_col``, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) and ``evidence``, the mean of a character.

    ``held_out`` is a condition on the columns of ``docs``; those rows teach nothing. A null or empty text has no evidence, value 0; a label
    other than 0 and 1, null included, is not learned; repeated rows count as often as they occur. Without labels, evidence is 0 everywhere.
    """
    spark = docs.sparkSession
    python_ready(spark)
    known = fold(labels, {"label_id": id_col, "label": label_col}).where("label in (0, 1)").select("label_id", F.col("label").cast("int"))
    free = fold(docs.where(~F.coalesce(held_out, F.lit(False))), {"id": id_col, "text": text_col})
    curve = F.pmod(F.xxhash64(F.lit("curve"), F.col("id").cast("string")), F.lit(SLICES)) == 0
    # Labels grow with the corpus, so texts meet them by a shuffle at every size.
    taught = free.where(~curve).join(known.hint("merge"), F.col("id") == F.col("label_id")).select("label", "text")
    counts = taught.mapInPandas(_count, "gram string, ordinary long, toxic long").groupBy("gram")
    counts = counts.agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    counts = materialized(counts, "toxic-counts")

    read = fold(docs.withColumn("__held", F.coalesce(held_out, F.lit(False))), {"id": id_col, "held": "__held", "text": text_col})
    id_type = read.schema["id"].dataType
    texts = read.select(F.col("id").cast("string").alias("id"), "held", "text")
    packed = "ids array<string>, held array<boolean>, sizes array<int>, words binary, steps binary, times binary"
    blocks = texts.mapInPandas(_blocks, packed).withColumn("block", F.monotonically_increasing_id())
    blocks = materialized(blocks, "toxic-blocks")
    asked = materialized(blocks.select("block", "words").mapInPandas(_asked, "block long, gram string"), "toxic-asked")
    told = asked.join(evidence_of(counts, asked.select("gram").distinct()), "gram")
    judged = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(_judge, "id string, held boolean, mean double, peak double")
    raw = materialized(judged.withColumn("id", F.col("id").cast(id_type)), "toxic-evidence")
    level = F.least("mean", F.lit(MEAN_TOP))
    places = [
        F.least(F.greatest(F.round(value / width), F.lit(-most)), F.lit(most)).cast("int").alias(f"{name}_bin")
        for name, value, width, most in (("mean", level, MEAN_BIN, MEAN_BINS), ("peak", F.col("peak"), PEAK_BIN, PEAK_BINS))
    ]
    bins = raw.where(~F.col("held") & curve).join(known, F.col("id") == F.col("label_id")).groupBy(*places)
    bins = bins.agg(F.sum(1 - F.col("label")).alias("ordinary"), F.sum("label").alias("toxic")).orderBy("mean_bin", "peak_bin").collect()
    of_mean, of_peak, offset = _logistic([tuple(b) for b in bins])
    value = 1 / (1 + F.exp(-(level * of_mean + F.col("peak") * of_peak + offset)))
    out = raw.select(F.col("id").alias(id_col), value.alias("score"), F.col("mean").alias("evidence"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
