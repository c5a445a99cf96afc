"""Quality classifier: a generalised additive model with pairwise interactions over figures of a text.

Each figure is cut into at most BINS bins at quantiles of the training sample. In each round every figure in turn gets a shallow tree
(two splits deep) on its bins, fitted to the gradients of the logistic loss, and the tree, shrunk, is added to the figure's lookup
table. Then the pairs whose bins explain most of what is left are chosen, and their two-way tables are boosted in the same cyclic way. A
score is the sigmoid of an intercept and the sum of looked-up values: no tree is walked when documents are scored.

Labels come from at most TRAIN_ROWS labelled documents, those with the smallest hash of their id among ids whose crc32 mod 4 isn't
HELD_OUT; a fifth of them decides how many rounds are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, text_column
from .quality import SYMBOLS, repeated_words

#: Bound of the labelled sample, whose figures reach the driver (some 200 bytes a row).
TRAIN_ROWS = 20_000
HELD_OUT = 2
CUT = 0.7
BINS, PAIR_BINS, PAIRS = 32, 16, 10
ROUNDS, PAIR_ROUNDS, PATIENCE = 200, 100, 20
RATE, RIDGE = 0.1, 1.0
FIGURES = (
    "words", "word_length", "symbols", "marks", "digits", "capitals", "caps_words", "distinct", "repeats_last", "commonest", "repeated_lines", "line_words",
    "closed_words", "repeated_passages", "short_words", "other_bytes", "entropy", "capital_words", "long_words", "bars", "sentence_words", "longest_repeat",
)
CAPITAL_WORD = re.compile(rb"(?<![^\s])[A-Z]")
CLOSED_WORD = re.compile(rb"[.,;:](?![^\s])")


def codes(chars: str) -> np.ndarray:
    return np.frombuffer(chars.encode(), dtype=np.uint8).astype(np.int64)


SYMBOL, MARK, DIGIT, BLANK = codes(SYMBOLS), codes("!?"), codes("0123456789"), codes(SPACES)
UPPER, LOWER = np.arange(65, 91), np.arange(97, 123)


def figures(text: str | None) -> list[float]:
    """FIGURES of a whole text: sizes as logarithms, the rest as shares; 0 where there is nothing to share. Null is empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FIGURES)
    count = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    chars = float(count.sum() - count[BLANK].sum())
    letters = max(1.0, float(count[UPPER].sum() + count[LOWER].sum()))
    seen = Counter(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=n)
    again = np.fromiter((a == b for a, b in zip(words, words[1:], strict=False)), dtype=bool, count=n - 1)
    edges = np.flatnonzero(np.concatenate([[True], ~again, [True]]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    part = count[count > 0] / len(data)
    return [
        np.log1p(n), chars / n, count[SYMBOL].sum() / chars, count[MARK].sum() / chars, count[DIGIT].sum() / chars, count[UPPER].sum() / letters, sum(map(bytes.isupper, words)) / n, len(seen) / n,
        again.sum() / n, max(seen.values()) / n, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), len(CLOSED_WORD.findall(data)) / n, repeated_words(words) / n, (size <= 3).mean(), count[128:].sum() / chars,
        -(part * np.log2(part)).sum(), len(CAPITAL_WORD.findall(data)) / n, (size > 15).mean(), count[124] / chars, np.log1p(n / (1 + count[46] + count[33] + count[63])), np.diff(edges).max() / n,
    ]


@dataclass
class Model:
    """edges: each figure's bin borders; tables: a value for each figure and bin; pairs with pair_tables: values for two coarser bins."""

    edges: list[np.ndarray]
    intercept: float
    tables: np.ndarray
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def binned(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, rows[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.intercept)
        for k, table in enumerate(self.tables):
            out += table[bins[:, k]]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[bins[:, a] * PAIR_BINS // BINS, bins[:, b] * PAIR_BINS // BINS]
        return out

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.binned(rows)), -30, 30)))


def gain(g, h):
    return g * g / (h + RIDGE)


def best_split(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gain, place) of the best split along the last axis: what is before and at the place, and what is behind it."""
    left_g, left_h = np.cumsum(g, axis=-1), np.cumsum(h, axis=-1)
    all_g, all_h = left_g[..., -1:], left_h[..., -1:]
    gains = gain(left_g, left_h) + gain(all_g - left_g, all_h - left_h)
    at = gains.argmax(axis=-1)
    return np.take_along_axis(gains, at[..., None], -1)[..., 0], at


def leaf(g: np.ndarray, h: np.ndarray) -> float:
    return RATE * g.sum() / (h.sum() + RIDGE)


def line_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values of a tree two splits deep over the bins of one figure."""
    out, (_, at) = np.zeros(len(g)), best_split(g, h)
    for a, b in ((0, int(at) + 1), (int(at) + 1, len(g))):
        if a < b:
            cut = a + int(best_split(g[a:b], h[a:b])[1]) + 1
            out[a:cut] = leaf(g[a:cut], h[a:cut])
            out[cut:b] = leaf(g[cut:b], h[cut:b])
    return out


def square_split(g: np.ndarray, h: np.ndarray) -> tuple[float, int, int, int]:
    """(gain, place, place before it, place behind it): a split of the rows, and on either side its own of the columns."""
    up_g, up_h = np.cumsum(g, axis=0), np.cumsum(h, axis=0)
    above, left = best_split(up_g, up_h)
    below, right = best_split(up_g[-1] - up_g, up_h[-1] - up_h)
    at = int((above + below).argmax())
    return float(above[at] + below[at]), at, int(left[at]), int(right[at])


def square_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values of a tree over two figures' bins: split by the one, then by the other, whichever order gains more."""
    one, two = square_split(g, h), square_split(g.T, h.T)
    if two[0] > one[0]:
        return square_tree_by(g.T, h.T, two).T
    return square_tree_by(g, h, one)


def square_tree_by(g, h, split) -> np.ndarray:
    out, (_, at, left, right) = np.zeros(g.shape), split
    for rows, cut in ((slice(0, at + 1), left), (slice(at + 1, None), right)):
        for columns in (slice(0, cut + 1), slice(cut + 1, None)):
            out[rows, columns] = leaf(g[rows, columns], h[rows, columns])
    return out


def loss(y: np.ndarray, raw: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0, -raw, raw)).mean()) if len(y) else 0.0


def boosted(y, test, raw, cells: list[np.ndarray], shapes: list[tuple], tree, rounds: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Tables of each cell index, by rounds over all of them, as they were when the loss on test rows was least; and raw with them."""
    tables = [np.zeros(s) for s in shapes]
    best, kept, idle = loss(y[test], raw[test]), [t.copy() for t in tables], 0
    fits, now = np.where(test, 0.0, 1.0), raw.copy()
    for _ in range(rounds):
        for table, cell, shape in zip(tables, cells, shapes, strict=True):
            p = 1 / (1 + np.exp(-np.clip(now, -30, 30)))
            g = np.bincount(cell, weights=(y - p) * fits, minlength=int(np.prod(shape))).reshape(shape)
            h = np.bincount(cell, weights=p * (1 - p) * fits, minlength=int(np.prod(shape))).reshape(shape)
            step = tree(g, h)
            table += step
            now += step.ravel()[cell]
        found = loss(y[test], now[test])
        best, kept, idle = (found, [t.copy() for t in tables], 0) if found < best - 1e-6 else (best, kept, idle + 1)
        if idle >= PATIENCE and test.any():
            break
    if not test.any():
        kept = tables
    return kept, raw + sum(t.ravel()[c] for t, c in zip(kept, cells, strict=True))


def trained(rows: np.ndarray, y: np.ndarray, test: np.ndarray) -> Model:
    """The model of rows of FIGURES with labels 0 or 1; rows marked as test choose the number of rounds. Without two labels it is constant."""
    k = len(FIGURES)
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(rows[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) if len(rows) else np.zeros(0) for i in range(k)]
    model = Model(edges, start, np.zeros((k, BINS)), [], [])
    if len(np.unique(y[~test])) < 2:
        return model
    bins = model.binned(rows)
    raw = np.full(len(y), start)
    tables, raw = boosted(y, test, raw, list(bins.T), [(BINS,)] * k, line_tree, ROUNDS)
    model.tables = np.stack(tables)
    coarse = bins * PAIR_BINS // BINS
    p = 1 / (1 + np.exp(-raw))
    fits = ~test
    ranked = []
    for a, b in combinations(range(k), 2):
        cell = (coarse[:, a] * PAIR_BINS + coarse[:, b])[fits]
        g, h = (np.bincount(cell, weights=w[fits], minlength=PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for w in (y - p, p * (1 - p)))
        ranked.append((-max(square_split(g, h)[0], square_split(g.T, h.T)[0]), a, b))
    model.pairs = [(a, b) for _, a, b in sorted(ranked)[:PAIRS]]
    cells = [coarse[:, a] * PAIR_BINS + coarse[:, b] for a, b in model.pairs]
    model.pair_tables, _ = boosted(y, test, raw, cells, [(PAIR_BINS, PAIR_BINS)] * len(cells), square_tree, PAIR_ROUNDS)
    return model


def draw(doc="doc_id"):
    return F.crc32(F.col(doc).cast("string").cast("binary"))


def label_sample(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, quality, test) of at most so many documents with a label 0 or 1 that aren't held out; of several labels the lower."""
    known = labels.where(F.col("quality").isin(0, 1) & (draw() % 4 != HELD_OUT)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    order = F.xxhash64(F.col("doc_id"), F.lit("labels"))
    return known.orderBy(order, "doc_id").limit(rows).select("doc_id", "quality", (F.pmod(order, F.lit(5)) == 0).alias("test"))


def text_figures(text="text"):
    """A struct column with one array of FIGURES for a text column."""
    return text_column(lambda: lambda texts: [[figures(t) for t in texts]], "x array<double>")(text)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled ones among docs. At most TRAIN_ROWS rows of figures reach the driver, one for each id, however often
    an id is repeated (of its texts the one with the least figures)."""
    sample = docs.sparkSession.createDataFrame(label_sample(labels).toArrow())
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "test", text_figures().alias("f"))
    rows = known.groupBy("doc_id").agg(F.min("f.x").alias("x"), F.first("quality").alias("quality"), F.first("test").alias("test")).orderBy("doc_id").toArrow()
    x = np.array(rows["x"].to_pylist(), dtype=np.float64).reshape(-1, len(FIGURES))
    return trained(x, np.array(rows["quality"].to_pylist(), dtype=np.float64), np.array(rows["test"].to_pylist(), dtype=bool))


def quality_score(model: Model, text="text"):
    """A struct column (score double) for a text column, 0 to 1; a null text scores as an empty one."""
    return text_column(lambda: lambda texts: [model.scores(np.array([figures(t) for t in texts]))], "score double")(text)


def score_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs; other columns are left out.

    Only whole texts are scored, never labels, lang, source or id. Null texts are empty and score as such; rows without id aren't
    held out; equal texts score alike and repeated rows stay; without labels of both kinds every score is the same; an empty table gives
    no rows.
    """
    rows = docs.select("doc_id", "text")
    score = F.col("q.score")
    found = rows.select("doc_id", quality_score(fit(rows, labels)).alias("q"))
    return found.select("doc_id", F.coalesce(draw() % 4 == HELD_OUT, F.lit(False)).alias("held_out"), score.alias("score"), (score >= CUT).cast("int").alias("predicted"))
