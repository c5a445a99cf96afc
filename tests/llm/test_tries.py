"""The trie of conversation prefixes against one built in plain Python."""

import hashlib
import random
import zlib

import compare
import pytest

from rostrum.llm import queries, tries

CONV = "conv_id long, turn long, role string, text string, name string, names string, items string, depth string, above string"


def talks():
    """Short and long talks, shared openings of all lengths, equal ones, nulls, ties, repeated turns and rows without a talk."""
    rng = random.Random(11)
    line = [("user" if k % 2 else "assistant", f"line {k} of ñandú " + "x" * (k % 5)) for k in range(140)]
    rows = []

    def put(c, turns):
        rows.extend((c, k, role, text) for k, (role, text) in enumerate(turns))

    for c in range(40):  # one stem, left at different depths
        cut = rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 31, 33, 64, 65, 100, 130])
        put(c, line[:cut] + [("user", f"own {c} {k}") for k in range(rng.randrange(4))])
    for c in range(200, 230):
        put(c, [("user", rng.choice("abc")) for _ in range(rng.randrange(1, 7))])
    for c in range(300, 320):  # all equal
        put(c, line[:5])
    put(401, line[:1])  # its hundred's first one is absent
    put(402, line[:9])
    put(-105, line[:3])
    rows += [(500, None, None, None), (500, 0, None, "null first"), (500, 3, "b", "tie"), (500, 3, "a", "tie"), (500, 3, "a", "tie"), (None, 0, "user", "nobody"), (500, 2, "", None)]
    rng.shuffle(rows)
    return rows


def trie(sequences):
    """The contract's rows from {conv_id: [(role, text)]}."""
    members, ends = {}, {}
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    children, leaves, saved = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = leaves.get(p, 0) or 1
        saved[p] = saved.get(p, 0) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        if p:
            up = p[:-1]
            children[up] = children.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[p]
            saved[up] = saved.get(up, 0) + saved[p]
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], sha(ends.get(p, []))) for p, m in members.items()), key=repr)


def listed(rows):
    by = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            code = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            by.setdefault(c, []).append((turn is not None, turn or 0, role, code, text))
    return {c: [(x[2], x[4]) for x in sorted(v)] for c, v in by.items()}


def opened(lists):
    out = {}
    for c, seq in lists.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = lists.get(first, [])[:h] + seq[h:]
    return out


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(*r, "n", "m", "i", "d", "a") for r in talks()], CONV).repartition(5)


def test_whole_talks(frame):
    assert found(tries.conversation_trie(frame)) == trie(listed(talks()))


def test_shared_openings_and_members_in_parts(frame, monkeypatch):
    monkeypatch.setattr(tries, "LISTED_BITS", 1)
    got = tries.shared_opening_trie(frame)
    assert ", ".join(f"{n} {t}" for n, t in got.dtypes).replace("bigint", "long") == tries.NODES
    assert found(got) == trie(opened(listed(talks())))


def test_a_talk_without_turns_and_one_talk(spark):
    c = next(c for c in range(401, 500) if zlib.crc32(str(c).encode()) % 6 > 1)
    one = spark.createDataFrame([(c, 0, "user", "hi", *"nmida")], CONV)
    assert found(tries.shared_opening_trie(one)) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert found(tries.conversation_trie(one)) == trie({c: [("user", "hi")]})


def test_no_talks(spark):
    assert tries.shared_opening_trie(spark.createDataFrame([], CONV)).count() == 0
    assert tries.conversation_trie(spark.createDataFrame([(None, 1, "user", "x", *"nmida")], CONV)).count() == 0


def test_a_text_longer_than_a_slice(spark):
    rows = [(1, 0, "user", "é" * 1_500_000, *"nmida"), (2, 0, "user", "é" * 1_500_000, *"nmida")]
    assert found(tries.conversation_trie(spark.createDataFrame(rows, CONV)))[0][6] == 1_500_000


def test_equal_to_sql(spark, sf, con):
    assert compare.differences(queries.QUERIES["op11_prefix_trie"](spark, sf), con, queries.ORACLES["op11_prefix_trie"]) is None
