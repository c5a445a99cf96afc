"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus, beside four plain rules.

Word unigrams and bigrams (letters A-Z lowered) are hashed to BUCKETS multinomial cells. With t and r the counts of a cell
in the trusted target and in the raw corpus, T and R their sums and e = T r / R what the target would hold if it were like the
corpus, the cell weighs log((t + 1) / (e + 1)). A document's score is the mean weight of its n-grams, so long and short ones
are judged alike, and it is kept if the score reaches the model's threshold.

The raw multinomial counts every document, the target all trusted labelled ones but a held-out half (by a bit of their id's hash),
whose scores, all of them, set the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, shuffles_freed, slices, stored, text_column, unused
from .mixing import numbered

BUCKETS = 1 << 16
#: Trusted ids (16 bytes each) up to which they are broadcast to spare a shuffle of texts; more are joined by a shuffle.
BROADCAST_ROWS = 400_000
#: The held-out share of trusted documents that the threshold may lose.
LOSS = 0.0005
#: Used where no trusted row is at hand: every document passes.
NO_THRESHOLD = -1e9
CACHED_WORDS = 200_000
SYMBOLS = "#*$%&|<>"
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, base_failed boolean, kept boolean"


@dataclass(frozen=True)
class Model:
    """weights: float32, one for each bucket; threshold: the least score that is kept."""

    weights: np.ndarray
    threshold: float


class Grams:
    """Buckets of a document's word unigrams and bigrams."""

    def __init__(self):
        self.cache: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        if len(cache) > CACHED_WORDS:
            cache.clear()
        for w in words:
            if w not in cache:
                cache[w] = xxhash.xxh64_intdigest(w.lower(), 7)
        h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
        pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ (h[1:] >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        shift = np.uint64(64 - BUCKETS.bit_length() + 1)
        return np.concatenate([h >> shift, (pairs ^ (pairs >> np.uint64(29))) * np.uint64(0x165667B19E3779F9) >> shift]).astype(np.int64)


def repeated_words(words: list, window: int = 5) -> int:
    """Words that lie in windows of so many words that are found twice or more."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    if len(ids) == n:
        return 0
    key, cells = at, len(ids)
    for k in range(1, window):
        if cells * len(ids) >= 1 << 62:
            found, key = np.unique(key, return_inverse=True)
            cells = len(found)
        key = key[:-1] * len(ids) + at[k:]
        cells *= len(ids)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def rules(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    chars = len(text) - sum(text.count(c) for c in SPACES)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


def quality(model: Model, text="text"):
    """A struct column (FIELDS) for a text column; a null text has no words and fails the base rules."""

    def make():
        grams = Grams()
        weights, threshold = model.weights.astype(np.float64), model.threshold

        def apply(texts):
            out = []
            for t in texts:
                words = (t or "").encode("utf-8", "surrogatepass").split()
                at = grams(words)
                score = float(weights[at].sum() / len(at)) if len(at) else 0.0
                found = rules(t or "", words)
                failed = found[0] < 10 or 100 * found[4] > 20 * found[0]
                out.append((*found, score, failed, not failed and score >= threshold))
            return list(zip(*out, strict=True))

        return apply

    return text_column(make, FIELDS)(text)


def trusted_sample(labels: DataFrame) -> DataFrame:
    """(doc_id, held) of all trusted labelled rows: quality 1 and not toxic. held marks the half that sets the threshold."""
    h = F.xxhash64(F.col("doc_id"), F.lit("trusted"))
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.select("doc_id", ((h.bitwiseAND(F.lit(1))) == 1).alias("held"))


def gram_counts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(bucket, raw, target) over all documents: each task adds up its own rows, a sum over buckets the tasks' parts."""

    def count(batches):
        grams, total = Grams(), np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            at = 0
            held = batch.column(1).to_pylist()
            for part in slices(batch.column(0)):
                texts = part.to_pylist()
                found = [grams((t or "").encode("utf-8", "surrogatepass").split()) for t in texts]
                counted = [x for x, h in zip(found, held[at : at + len(texts)], strict=True) if h is False]
                for k, x in ((0, found), (1, counted)):
                    if x:
                        total[k] += np.bincount(np.concatenate(x), minlength=BUCKETS)
                at += len(texts)
        full = np.flatnonzero(total[0])
        for i in range(0, len(full), 1 << 14):
            x = full[i : i + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(total[0][x]), pa.array(total[1][x])], names=["bucket", "raw", "target"])

    rows = docs.join(sample, "doc_id", "left").select("text", "held")
    return rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def quantile(scores: DataFrame, share: float) -> float | None:
    """The exact quantile of the column score, null where there is no score: a range sort, of which two rows reach the driver. Between
    two places it is in proportion."""
    ranked = cut(numbered(scores.where("score is not null").withColumn("tie", F.monotonically_increasing_id()), "score", "tie"))
    at = (ranked.count() - 1) * share
    if at < 0:
        return None
    below = int(at)
    around = [r["score"] for r in ranked.where(F.col("n").isin(below, below + 1)).orderBy("n").collect()]
    return around[0] + (at - below) * (around[-1] - around[0])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of these documents. What reaches the driver is BUCKETS rows of counts and two scores, whatever the input."""
    sample = cut(trusted_sample(labels))
    few = sample.count() <= BROADCAST_ROWS  # else texts are shuffled, and freed when counted
    near = F.broadcast if few else lambda df: df
    with shuffles_freed(docs.sparkSession):
        counts = gram_counts(docs.select("doc_id", "text"), near(sample)).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = np.asarray(counts["bucket"])
    raw[at], target[at] = np.asarray(counts["raw"]), np.asarray(counts["target"])
    if not target.sum():
        return Model(np.zeros(BUCKETS, dtype=np.float32), NO_THRESHOLD)
    weights = np.log((target + 1) / (raw * (target.sum() / raw.sum()) + 1)).astype(np.float32)
    held = docs.join(near(sample.where("held")), "doc_id", "left_semi").select(quality(Model(weights, NO_THRESHOLD), "text").alias("q"))
    scores = stored(held.select(F.when(~F.col("q.base_failed"), F.col("q.score")).alias("score")))  # no filter, which would be judged before the join
    threshold = quantile(scores, LOSS)
    return Model(weights, NO_THRESHOLD if threshold is None else threshold)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and score for every row of docs; other columns are left out.

    Null texts count as empty and fail; ties and repeated rows are judged alike; texts of any length are read whole; an empty table
    gives no rows.
    """
    rows = docs.select("doc_id", "text")
    return rows.select("doc_id", quality(fit(rows, labels)).alias("q")).select("doc_id", "q.*")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that pass, with all their columns as they are. Null texts don't; repeated rows pass or fail together; long texts
    are read whole; an empty table gives no rows; without trusted rows all that pass the base rules stay."""
    model = fit(docs.select("doc_id", "text"), labels)
    mark = unused(docs)
    return docs.withColumn(mark, quality(model)).where(F.col(f"{mark}.kept")).drop(mark)
