"""Texts longer than a slice in the operators that other tests don't give any, and the quality score and verdict by brute force."""

import math
import random

import numpy as np
import pytest
import xxhash
from test_operators import VOCAB, brute_fingerprint, corpus

from rostrum.llm import attribution, common, html, mixing, quality, secrets, simhash
from rostrum.llm.tokens import vocabulary_path


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(31)
    text = " ".join(f"{rng.choice(VOCAB)}{rng.randrange(900)}" for _ in range(160_000))
    assert len(text) > common.SLICE_BYTES
    return text


@pytest.fixture(scope="module")
def long_docs(spark, long_text):
    key = "AKIA" + "Z" * 20
    rows = [(1, f"{key} {long_text} {key}"), (2, f"{long_text} {key} end"), (3, "short"), (4, None)]
    return spark.createDataFrame([(k, t, "s", None if t is None else len(t)) for k, t in rows], "doc_id long, text string, source string, n_chars long").coalesce(1)


def test_tokens_of_long_texts(long_docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary_path())
    texts = {r["doc_id"]: r["text"] for r in long_docs.collect()}
    found = {}
    for r in attribution.section_report(long_docs, 100_000).collect():
        found.setdefault(r["doc_id"], []).append(r)
    for k, rows in found.items():
        n = len(tok.encode(texts[k] or "", add_special_tokens=False).ids)
        assert {r["doc_tokens"] for r in rows} == {n} and sum(r["n_tokens"] for r in rows) == n


def test_secrets_of_long_texts(long_docs, long_text):
    rows = {r["doc_id"]: r for r in secrets.secret_report(long_docs).collect()}
    n = len(long_text)
    spans = [s for s in rows[1]["spans"].split(",") if s.startswith("access")]
    assert spans == ["access:0:24", f"access:{n + 26}:{n + 50}"] and [rows[k]["n_access"] for k in (1, 2, 3, 4)] == [2, 1, 0, 0]
    kept = {r["doc_id"]: r for r in secrets.redacted(long_docs).collect()}
    assert kept[2]["text"] == f"{long_text} [redacted] end" and kept[2]["n_chars"] == len(kept[2]["text"]) and kept[4]["text"] is None


def test_near_copies_and_mix_of_long_texts(long_docs):
    rows = {r["doc_id"]: r for r in simhash.near_duplicate_report(long_docs).collect()}
    for r in long_docs.collect():
        assert rows[r["doc_id"]]["fingerprint"] == f"{brute_fingerprint(r['text']):016x}"
    assert sorted(r["doc_id"] for r in simhash.one_of_each(long_docs).collect()) == [1, 3, 4]
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix_report(long_docs).collect()}
    copies = {}
    for r in mixing.mixed(long_docs).select("doc_id").collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert taken[1][0] == 160_002 and all(n * copies.get(k, 0) == t for k, (n, t) in taken.items())


def test_long_pages(spark, long_text):
    page = f"<html><body><nav><a href='/'>Home</a></nav><div><p>{'</p><p>'.join(long_text[i : i + 900] for i in range(0, len(long_text), 900))}</p></div><footer>end</footer></body></html>"
    row = html.extracted(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()
    assert row["text"].replace(" ", "") == long_text.replace(" ", "") and row["n_chars"] == len(row["text"])


def grams(text):
    """Buckets of unigrams and bigrams, one by one."""
    top = 64 - quality.BUCKETS.bit_length() + 1
    mask = (1 << 64) - 1
    h = [xxhash.xxh64_intdigest(w.lower(), 7) for w in (text or "").encode().split()]
    out = [x >> top for x in h]
    for a, b in zip(h, h[1:], strict=False):
        p = (a * 0x9E3779B97F4A7C15 & mask) + ((b ^ (b >> 31)) * 0xC2B2AE3D27D4EB4F & mask) & mask
        out.append(((p ^ (p >> 29)) * 0x165667B19E3779F9 & mask) >> top)
    return out


def test_score_and_verdict_by_brute_force(spark):
    texts = {k: t for k, t, *_ in corpus()}
    rows = [(k, t) for k, t, *_ in corpus()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, 1, k == 3) for k in range(24)] + [(40, 0, False), (None, 1, False)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "cast(toxic as int) toxic")
    sample = {r["doc_id"]: r["held"] for r in quality.trusted_sample(labels).collect()}
    assert set(sample) == set(range(24)) - {3} and len(set(sample.values())) == 2
    raw, target = {}, {}
    for k, t in rows:
        for x in grams(t):
            raw[x] = raw.get(x, 0) + 1
            if sample.get(k) is False:
                target[x] = target.get(x, 0) + 1
    share = sum(target.values()) / sum(raw.values())
    weight = {x: float(np.float32(math.log((target.get(x, 0) + 1) / (n * share + 1)))) for x, n in raw.items()}
    score = lambda t: sum(weight[x] for x in grams(t)) / len(grams(t)) if grams(t) else 0.0
    got = quality.quality_report(docs, labels).collect()
    failed = {k: r["base_failed"] for r in got for k in [r["doc_id"]]}
    held = [score(t) for k, t in rows if sample.get(k) and not failed[k]]
    least = float(np.quantile(held, quality.LOSS))
    for r in got:
        text = texts[r["doc_id"]] if r["doc_id"] is not None else texts[5]
        assert math.isclose(r["score"], score(text), abs_tol=1e-9)
        assert r["kept"] == (not r["base_failed"] and score(text) >= least - 1e-12)
    assert {r["kept"] for r in got if not r["base_failed"]} == {True, False}
