"""Inputs made to be slow or large: they take time and memory in proportion to their size, and results stay what plain rules give."""

import random
import re
import struct
import time

import pytest

from rostrum.llm import secrets, tiff

BY_KIND = {r.kind: r for r in secrets.RULES}


def spans(kind, text):
    rule = BY_KIND[kind]
    return [(m.start(), m.end()) for m in rule.finder(re.compile(rule.pattern, rule.flags | re.ASCII), text)]


@pytest.mark.parametrize("kind", ["login", "jwt"])
def test_finders_equal_plain_searches(kind):
    rng = random.Random(kind)
    parts = ["://", ":", "@", "/", "a", "Z9", "+.-", "user", "pw12", " ", "eyJ", "eyJhbGciOi", ".", "_-", "abcdefgh", "é", "http://u:pass@h"]
    parts = parts if kind == "login" else ["eyJ", "eyJhbGciOi", ".", ".", "_-", "abcdefgh", "abcdefghi", " ", "é"]
    compiled = re.compile(BY_KIND[kind].pattern, re.ASCII)
    some = 0
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 30)))
        want = [(m.start(), m.end()) for m in compiled.finditer(text)]
        assert spans(kind, text) == want, text
        some += bool(want)
    assert some > 100


@pytest.mark.parametrize("kind, text", [("login", "x://y " + "a" * 1_000_000), ("login", "a" * 1_000_000 + "://y"), ("login", "a://" * 250_000), ("login", "ab+://u:" * 120_000), ("jwt", "eyJ" * 330_000), ("jwt", "eyJabcdefgh." * 80_000), ("jwt", "eyJabcdefgh.x" * 80_000)])
def test_a_megabyte_takes_under_a_second(kind, text):
    began = time.perf_counter()
    spans(kind, text)
    assert time.perf_counter() - began < 1.0


def shared_strip(directories: int, columns: int = 4096, rows: int = 3700) -> bytes:
    """A file whose directories all point to one deflated strip."""
    packed = tiff.ENCODERS[tiff.DEFLATE](bytes(columns * rows))
    out = bytearray(b"II" + struct.pack("<HI", 42, 8 + len(packed)) + packed)
    for k in range(directories):
        tags = [(tiff.WIDTH, columns), (tiff.HEIGHT, rows), (tiff.BITS, 8), (tiff.COMPRESSION, tiff.DEFLATE), (tiff.PHOTOMETRIC, 1), (tiff.STRIP_AT, 8), (tiff.SAMPLES, 1), (tiff.STRIP_ROWS, rows), (tiff.STRIP_SIZE, len(packed))]
        body = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in sorted(tags))
        last = k == directories - 1
        out += body + struct.pack("<I", 0 if last else len(out) + len(body) + 4)
    return bytes(out)


def test_pages_that_share_a_strip_are_no_larger_than_the_file_can_be(spark):
    one, many = shared_strip(1), shared_strip(20)
    rows = spark.createDataFrame([(1, one), (2, many), (3, None)], "k int, media binary")
    got = {}
    for r in tiff.page_rows(rows).select("k", "error", "p.page", "p.width").collect():
        got.setdefault(r["k"], []).append(r)
    assert len(got[1]) == 1 and got[1][0]["error"] is None and got[1][0]["width"] == 4096
    assert "the sum of pages" in got[2][0]["error"] and len(got[2]) * 4096 * 3700 < 100_000_000
    assert [r["page"] for r in got[2]] == list(range(len(got[2]))) and got[3][0]["page"] is None


def test_honest_files_of_many_pages_are_read():
    pages = [(bytes([k % 7] * 64 * 50), 64, 1) for k in range(300)]
    for compression in tiff.ENCODERS:
        found = list(tiff.decoded(tiff.encode(pages, compression)))
        assert [p["pixels"] for p in found] == [p[0] for p in pages]
