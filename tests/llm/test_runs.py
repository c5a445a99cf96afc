"""Runs of words against all periods tried at all places."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from rostrum.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(w):
    """(start, end, period), each with its least period: every period, ascending, at every place."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s >= q and i + q - s >= 12:
                out.setdefault((s, i + q), q)
    return sorted((s, e, q) for (s, e), q in out.items())


def by_sets(docs):
    flat = [x for k, d in enumerate(docs) for x in (*d, -1 - k)]
    return [tuple(r) for r in runs.runs_of(np.array(flat, dtype=np.int64), np.array([len(d) for d in docs], dtype=np.int64)).tolist()]


def by_force(docs):
    out, at = [], 0
    for d in docs:
        out += [(s + at, e + at, q) for s, e, q in all_runs(d)]
        at += len(d) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of_kind(rng, kind, n):
    if kind in (0, 1):
        return [rng.randrange((2, 1000)[kind]) for _ in range(n)]
    if kind == 2:  # one period with faults
        u = [rng.randrange(3) for _ in range(rng.randrange(1, 60))]
        d = (u * (n // len(u) + 1))[:n]
        for _ in range(rng.randrange(4)):
            d[rng.randrange(n)] = rng.randrange(3)
        return d
    if kind == 3:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 4:  # no cubes, many squares
        return [bin(i).count("1") % 2 for i in range(n)]
    if kind == 7:  # a period that is itself periodic but for its end
        u = [0, 1, 2, 1][: rng.randrange(2, 5)]
        block = u * rng.randrange(9, 26) + u[: rng.randrange(1, len(u))]
        return [3, 4][: rng.randrange(3)] + block * 2 + block[: rng.randrange(3)] + [4, 5][: rng.randrange(3)]
    small = [rng.randrange(3) for _ in range(rng.randrange(1, 4))]
    block = small * rng.randrange(3, 14) + [rng.randrange(4) for _ in range(rng.randrange(1, 4))]
    if kind == 6:
        block = block * rng.randrange(2, 6) + [rng.randrange(4)]
    k = rng.randrange(len(block))
    return [7, 8, 9][: rng.randrange(4)] + (block * 4)[k : k + 2 * len(block) + rng.randrange(-2, 9)] + [9, 8, 7][: rng.randrange(4)]


@pytest.mark.parametrize("seed", range(6))
def test_all_runs_are_found(seed):
    rng = random.Random(seed)
    for _ in range(40):
        docs = [words_of_kind(rng, rng.randrange(8), rng.randrange(1, 300)) for _ in range(rng.randrange(1, 6))] + [[]]
        assert by_sets(docs) == by_force(docs)


def test_both_ways_of_proposing_are_needed(monkeypatch):
    rng = random.Random(3)
    docs = [words_of_kind(rng, k % 8, 200) for k in range(240)]
    whole = set(by_sets(docs))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for name in ("near_pairs", "region_pairs"):
        with monkeypatch.context() as m:
            m.setattr(runs, name, lambda *_: none)
            assert set(by_sets(docs)) < whole


def test_long_periods_and_a_long_document():
    rng = random.Random(4)
    u = [rng.randrange(50) for _ in range(3000)]
    assert by_sets([u + u + u[:100], u[:10]]) == [(0, 6100, 3000)]
    assert by_sets([[1] * 20000]) == [(0, 20000, 1)] and by_sets([]) == [] and by_sets([[], [1]]) == []


def row_of(i, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = sorted(((s, e - s, q) for s, e, q in all_runs(w)), key=lambda r: (r[0], r[2]))
    out = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (i, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines), sha(" ".join(x for k, x in enumerate(w) if k not in out)))


def test_report(spark, monkeypatch):
    from rostrum.llm import common

    rng = random.Random(8)
    some = ["the", "stone", "river", "ñandú", "Straße", "ﬁ", "a b"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randrange(1, 90))) for _ in range(120)]
    texts += [None, "", " \t\n", "x", "a b " * 40, "a\x0bb\x0c" * 9, "one two three\n" * 5 + "end", "w " * 30 + "v " * 30, "long " * 3 + "z" * 9000]
    rows = [(k, t, "r", "q", "c") for k, t in enumerate(texts)] + [(3, texts[3], *"rqc"), (None, texts[126], *"rqc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, r string, runs string, collapsed string").repartition(3)
    monkeypatch.setattr(common, "SLICE_BYTES", 700)
    got = sorted((tuple(r) for r in runs.run_report(docs).collect()), key=repr)
    assert got == sorted((row_of(i, t) for i, t, *_ in rows), key=repr)
    assert any(r[1] for r in got) and runs.run_report(docs.limit(0)).count() == 0


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: tuple(r) for r in runs.run_report(docs).collect()}
    texts = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: len(r[1] or ""))[:180]
    assert [i for i, t in texts if got[i] != row_of(i, t)] == []
