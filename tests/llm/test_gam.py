"""The additive model: accuracy on what it hasn't seen, tables against trees walked one by one, and rows of every kind."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.llm import gam

DOC = "doc_id long, text string, q string, score string, held_out string"
LABEL = "doc_id long, quality int, toxic int"


def made(rng, good):
    words = [rng.choice("the stone river of cloud and lantern in copper window garden silver a winter meadow".split()) for _ in range(rng.randrange(30, 120))]
    if not good:
        kind = rng.randrange(3)
        words = [w.upper() + "!!" for w in words] if kind == 0 else [w + "$$" for w in words] if kind == 1 else [w for w in words[:9] for _ in range(9)]
    return " ".join(w + "." * (k % 9 == 8) for k, w in enumerate(words))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    return [(k, made(rng, k % 3 > 0), "q", "s", "h") for k in range(600)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(600)] + [(None, 0, 0), (5, None, None), (9, 7, 0)], LABEL)


def scores(docs, labels):
    return {r["doc_id"]: tuple(r) for r in gam.score_report(docs, labels).collect()}


def test_accuracy_on_held_out_documents_and_no_look_at_their_labels(spark, rows, labels):
    docs = spark.createDataFrame(rows, DOC).repartition(4)
    got = scores(docs, labels)
    held = {k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2}
    assert {k for k, r in got.items() if r[1]} == held
    assert sum(got[k][3] == (k % 3 > 0) for k in held) >= 0.97 * len(held)
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert scores(docs, turned) == got


def test_rows_of_every_kind(spark, rows, labels):
    odd = [(700, None, *"qsh"), (701, "", *"qsh"), (702, " \n ", *"qsh"), (703, "x", *"qsh"), (704, "A" * 200_000 + "b", *"qsh"), (705, "ñ " * 50_000, *"qsh"), (None, rows[1][1], *"qsh"), rows[1]]
    found = gam.score_report(spark.createDataFrame(rows + odd, DOC), labels).collect()
    assert len(found) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    assert len({r["score"] for k in (700, 701, 702) for r in by[k]}) == 1 and not by[None][0]["held_out"] and by[None][0]["score"] == by[1][0]["score"] == by[1][1]["score"]
    assert gam.score_report(spark.createDataFrame([], DOC), labels).count() == 0


def test_without_labels_of_both_kinds(spark, rows, labels):
    docs = spark.createDataFrame(rows[:40], DOC)
    for few in (labels.limit(0), labels.where("quality = 1")):
        assert len({r["score"] for r in gam.score_report(docs, few).collect()}) == 1


def test_an_id_that_many_rows_share_is_one_labelled_row(spark, rows, labels):
    docs = spark.createDataFrame(rows[:60] + [rows[4]] * 300, DOC)
    assert gam.label_sample(labels, 7).count() == 7 and gam.label_sample(labels).where("doc_id is null").count() == 0
    again = gam.fit(docs, labels), gam.fit(docs.dropDuplicates(), labels)
    assert np.array_equal(again[0].tables, again[1].tables)


def test_figures_by_hand():
    got = dict(zip(gam.FIGURES, gam.figures("One TWO two two.\nOne TWO two two.\n9 #x é|!"), strict=True))
    n, chars = 11, 3 + 3 + 3 + 4 + 3 + 3 + 3 + 4 + 1 + 2 + 4
    want = {"words": np.log1p(n), "symbols": 2 / chars, "marks": 1 / chars, "digits": 1 / chars, "caps_words": 2 / n, "distinct": 7 / n, "repeats_last": 0, "commonest": 2 / n, "repeated_lines": 1 / 3, "closed_words": 2 / n, "other_bytes": 2 / chars, "capital_words": 4 / n, "longest_repeat": 1 / n}
    assert {k: round(float(got[k]), 9) for k in want} == {k: round(float(v), 9) for k, v in want.items()}
    assert gam.figures(None) == gam.figures(" ") == [0.0] * len(gam.FIGURES)


def split_by_force(g, h):
    """Gain of the best tree that splits the rows, then either part's columns."""
    gain = lambda a, b: a.sum() ** 2 / (b.sum() + gam.RIDGE)
    sides = lambda i, s: max(gain(g[s, : j + 1], h[s, : j + 1]) + gain(g[s, j + 1 :], h[s, j + 1 :]) for j in range(g.shape[1]))
    return max(sides(i, slice(0, i + 1)) + sides(i, slice(i + 1, None)) for i in range(g.shape[0]))


def test_splits_are_the_best_ones():
    rng = np.random.default_rng(1)
    for _ in range(20):
        g, h = rng.normal(size=(6, 5)), rng.random((6, 5)) + 0.1
        assert np.isclose(gam.square_split(g, h)[0], split_by_force(g, h))
        line = gam.line_tree(g[0], h[0])
        assert len(set(line.tolist())) <= 4


def test_an_interaction_is_learnt_by_pairs_alone():
    rng = np.random.default_rng(5)
    x = np.zeros((3000, len(gam.FIGURES)))
    x[:, 3], x[:, 8] = rng.random(3000), rng.random(3000)
    y = ((x[:, 3] > 0.5) ^ (x[:, 8] > 0.5)).astype(float)
    model = gam.trained(x, y, np.arange(3000) % 5 == 0)
    assert (3, 8) in model.pairs and (((model.scores(x) > 0.5) == y).mean()) > 0.95
    model.pair_tables = [np.zeros_like(t) for t in model.pair_tables]
    assert ((model.scores(x) > 0.5) == y).mean() < 0.65
