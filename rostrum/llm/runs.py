"""Runs: stretches of words with a period, found by string synchronising sets.

At scale t (a power of two) blocks of t words are named by a hash. A place i is in the set if the least name of blocks that begin
at i to i + t, periodic blocks (period t / 3 or less) left out, is that of i or of i + t: a choice that depends on the 2t words from
i alone, so equal contexts are chosen alike, and contexts of equal blocks are t / 3 apart at least. A run of period q in [3t, 6t) holds
a chosen place and, q words on, its like: pairs of places with equal contexts at such a distance propose it. Where the first period has none, it
lies in one region of a smaller period p, and the run begins in one such region and goes on in the next, which begins where the first
ends: such pairs of regions propose it. Periods under SMALL are found by comparing words so far apart. Each proposal is widened
by fingerprints of stretches to where the period ends, and compared word by word.

Words of many documents stand in one array with a mark of its own behind each, so no run crosses documents and a step works on a
whole slice; at each scale only documents of six blocks or more stay.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_column

#: Least words of a run, whatever its period.
LEAST = 12
#: Periods below it are found by comparing words so far apart, without blocks: three times the first scale.
SMALL, FIRST_SCALE = 12, 4
PRIMES = (2147483647, 2147483629)
BASES = (1181783497, 1276758941)
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    h = (a ^ (b >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9) ^ (h >> np.uint64(32))


class Stretches:
    """Fingerprints of all stretches of an array: sums of words times powers of a base, by two primes."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.n, self.sums, self.powers = n, [], []
        for prime, base in zip(PRIMES, BASES, strict=True):
            power = np.ones(1, dtype=np.uint64)
            step = base
            while len(power) < n + 1:
                power = np.concatenate([power, power * np.uint64(step) % np.uint64(prime)])
                step = step * step % prime
            power = power[: n + 1]
            values = (mixed(words.astype(np.uint64), np.full(n, 77, dtype=np.uint64)) % np.uint64(prime)) * power[:n] % np.uint64(prime)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64) % np.uint64(prime)]))
            self.powers.append(power)

    def same(self, i: np.ndarray, lag: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the words from i and from i + lag on agree over a length."""
        out = np.ones(len(i), dtype=bool)
        for prime, sums, powers in zip(PRIMES, self.sums, self.powers, strict=True):
            p = np.uint64(prime)
            here, there = (sums[i + length] + p - sums[i]) % p, (sums[i + lag + length] + p - sums[i + lag]) % p
            out &= here * powers[lag] % p == there
        return out

    def widened(self, i: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(from, to) of the longest stretch around i whose words equal those a lag on; empty (i, i) where i's doesn't."""
        low, high = np.zeros(len(i), np.int64), self.n - lag - i  # words that agree from i on
        while (low < high).any():
            middle = (low + high + 1) // 2
            ok = self.same(i, lag, middle)
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        to = i + low
        low, high = np.zeros(len(i), np.int64), i.copy()  # and before it
        while (low < high).any():
            middle = (low + high + 1) // 2
            ok = self.same(i - middle, lag, middle)
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        return np.where(to > i, i - low, i), to


def least_ahead(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each value and the width ones behind it; by blocks of width, from both of their ends."""
    n, w = len(values), width + 1
    full = np.full(-(-n // w) * w + w, NEVER, dtype=np.uint64)
    full[:n] = values
    cells = full.reshape(-1, w)
    right = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
    left = np.minimum.accumulate(cells, axis=1).ravel()
    return np.minimum(right[:n], left[width : n + width])


class Found:
    """Runs of an array by their ends, each with its least period, as periods are tried in ascending order."""

    def __init__(self, words: np.ndarray):
        self.words, self.periods, self.stretches = words, {}, None

    def widen(self, i: np.ndarray, lag: np.ndarray) -> None:
        """Takes proposals: the place of a word that is equal to the one a lag on, in any order within a scale."""
        if not len(i):
            return
        if self.stretches is None:
            self.stretches = Stretches(self.words)
        start, to = self.stretches.widened(i, lag)
        long = to - start >= lag
        found = np.unique(np.stack([lag[long], start[long], to[long] + lag[long]], axis=1), axis=0)  # least period first
        for q, s, e in found.tolist():
            w = self.words
            if (s, e) not in self.periods and np.array_equal(w[s : e - q], w[s + q : e]):
                self.periods[s, e] = q

    def table(self) -> np.ndarray:
        """(start, end, period) of all, by start, then period."""
        rows = np.array([(s, e, q) for (s, e), q in self.periods.items()], dtype=np.int64).reshape(-1, 3)
        return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def small_periods(found: Found) -> None:
    """Periods under SMALL: stretches whose words equal those q on. Three periods count, as blocks may be periodic at less than LEAST."""
    w = found.words
    for q in range(1, min(SMALL, len(w))):
        unlike = np.flatnonzero(w[q:] != w[:-q])
        edges = np.concatenate([[-1], unlike, [len(w) - q]])
        gaps = np.flatnonzero(np.diff(edges) - 1 >= min(2 * q, max(LEAST - q, q)))
        for k in gaps.tolist():
            found.periods.setdefault((int(edges[k]) + 1, int(edges[k + 1]) + q), q)


def near_pairs(places: np.ndarray, contexts: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of places in ascending order with equal contexts, low to high - 1 apart. Equal ones aren't nearer than a
    twelfth of low to each other, so each has a bounded number of partners."""
    order = np.argsort(contexts, kind="stable")
    places, contexts = places[order], contexts[order]
    i, lag = [], []
    for step in range(1, len(places)):
        apart = places[step:] - places[:-step]
        near = (contexts[step:] == contexts[:-step]) & (apart < high)
        if not near.any():
            break
        at = np.flatnonzero(near & (apart >= low))
        i.append(places[at]), lag.append(apart[at])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *i]), np.concatenate([none, *lag])


def region_pairs(rows: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of runs with a period q in [3t, 6t) that begin in one region of a period of t / 3 or less and go on in the
    next of that period: q is tried from the last place but q of the first on."""
    i, lag = [], []
    some = rows[(rows[:, 2] * 3 <= t) & (rows[:, 1] - rows[:, 0] >= 3 * t - 1)]
    some = some[np.lexsort((some[:, 0], some[:, 2]))]
    for (a0, a1, p), (b0, b1, p2) in pairwise(some.tolist()):
        if p == p2 and a1 - p < b0 <= a1 + 1:
            q = np.arange(3 * t, min(6 * t, a1 - a0 + 2, b1 - b0 + 2))
            q = q[(a1 + 1 - q >= a0) & (a1 + 1 - q >= 0)]
            i.append(a1 + 1 - q), lag.append(q)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *i]), np.concatenate([none, *lag])


def runs_of(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs of documents whose words stand in one array, each with its own mark behind: maximal stretches of
    least period q and LEAST and 2q words or more."""
    found = Found(words)
    small_periods(found)
    ends = np.cumsum(lengths + 1)
    starts, doc = ends - lengths - 1, np.repeat(np.arange(len(lengths)), lengths + 1)
    here = np.arange(len(words))
    names, size, t = mixed(words.astype(np.uint64), np.full(len(words), 99, dtype=np.uint64)), 1, FIRST_SCALE
    longest = int(lengths.max(initial=0))
    while 6 * t <= longest:
        if len(here) > 2 * int((lengths[lengths >= 6 * t] + 1).sum()):  # short documents drop out
            stay = lengths[doc] >= 6 * t
            here, names, doc = here[stay], names[stay], doc[stay]
        while size < t:
            names = mixed(names, np.concatenate([names[size:], np.arange(min(size, len(names)), dtype=np.uint64)]))  # what reaches beyond the end is unlike anything
            size *= 2
        rows = found.table()
        periodic = np.zeros(len(words) + 1, dtype=np.int64)
        some = rows[(rows[:, 2] * 3 <= t) & (rows[:, 1] - rows[:, 0] >= t)]
        np.add.at(periodic, some[:, 0], 1)
        np.add.at(periodic, some[:, 1] - t + 1, -1)
        free = np.where(np.cumsum(periodic)[here] > 0, NEVER, names)
        least = least_ahead(free, t)
        behind = np.concatenate([free[t:], np.full(min(t, len(free)), NEVER, dtype=np.uint64)])
        chosen = np.flatnonzero((least != NEVER) & ((least == free) | (least == behind)))
        contexts = mixed(names, np.concatenate([names[t:], np.arange(min(t, len(names)), dtype=np.uint64)]))
        i, lag = near_pairs(here[chosen], contexts[chosen], 3 * t, 6 * t)
        j, other = region_pairs(rows, t)
        i, lag = np.concatenate([i, j]), np.concatenate([lag, other])
        inside = i + lag < len(words)
        found.widen(i[inside], lag[inside])
        t *= 2
    rows = found.table()
    return rows[rows[:, 1] - rows[:, 0] >= np.maximum(LEAST, 2 * rows[:, 2])]


def kept_words(n: int, rows: np.ndarray) -> np.ndarray:
    """Which of n words stay: none that lies in a run after that run's first period."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, rows[:, 0] + rows[:, 2], 1)
    np.add.at(edges, rows[:, 1], -1)
    return np.cumsum(edges)[:n] == 0


RUNS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic(text="text"):
    """A struct column (RUNS) for a text column: its number of words, runs by start and period, and the text without what repeats,
    words joined by one space. Null and empty texts have no words."""

    def make():
        def apply(texts):
            split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
            lengths = np.array([len(w) for w in split], dtype=np.int64)
            ids: dict[bytes, int] = {}
            flat = np.empty(int(lengths.sum()) + len(split), dtype=np.int64)
            at = 0
            for k, w in enumerate(split):
                flat[at : at + len(w)] = [ids.setdefault(x, len(ids)) for x in w]
                at += len(w)
                flat[at] = -1 - k
                at += 1
            rows = runs_of(flat, lengths)
            starts = np.cumsum(lengths + 1) - lengths - 1
            of = np.searchsorted(starts, rows[:, 0], side="right") - 1
            first = np.searchsorted(of, np.arange(len(split) + 1))
            runs, collapsed = [], []
            for k, w in enumerate(split):
                own = rows[first[k] : first[k + 1]]
                if len(own):
                    own = own - [starts[k], starts[k], 0]
                    keep = kept_words(len(w), own)
                    w = [x for x, ok in zip(w, keep.tolist(), strict=True) if ok]
                runs.append([{"start": s, "length": e - s, "period": q} for s, e, q in own.tolist()])
                collapsed.append(b" ".join(w).decode("utf-8", "surrogatepass"))
            return lengths, runs, collapsed

        return apply

    return text_column(make, RUNS)(text)


def with_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the words of one document in ten (crc32 of the id) repeating from some place on, period and place by the id
    too; the others, and those without id or words, are as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # a column of its own: within the function below it would be worked out anew for each word
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    g, n = F.floor(F.col("h") / 10).cast("long"), F.nullif(F.size("words").cast("long"), F.lit(0).cast("long"))
    rows = rows.select("doc_id", "text", "words", (g % n).alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).cast("long").alias("p"))
    again = F.transform("words", lambda w, i: F.when(i >= F.col("a"), F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(w))
    return rows.select("doc_id", F.when(F.size("words") > 0, F.concat_ws(" ", again)).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the longest run (ties: smallest start, then period), runs_sha256 and
    collapsed_sha256 for every row of docs, texts taken as with_period gives them; other columns are left out.

    Null and empty texts have no runs, four nulls and digests of nothing; repeated rows are judged alike, one by one; an empty table
    gives no rows; a text of any length is searched whole, in memory in proportion to it.
    """
    found = with_period(docs).select("doc_id", periodic("text").alias("r"))
    best = F.element_at(F.array_sort(F.transform("r.runs", lambda x: F.struct((-x["length"]).alias("longest"), x["start"].alias("start"), x["period"].alias("period")))), 1)
    best = F.when(F.size("r.runs") > 0, best)
    lines = F.array_join(F.transform("r.runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("r.runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "r.collapsed")
    length = -F.col("best.longest")
    return out.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), F.floor(length * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

