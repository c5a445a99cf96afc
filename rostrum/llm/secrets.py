"""Secret scans: a trigram inverted index answers, for each rule, which texts can hold a match; only those are searched.

From each rule's regular expression a Boolean trigram query is derived (trigrams over lower-case text, so it holds for either
case). The index covers just the trigrams that some query names; it is built segment by segment, a segment being the rows
that a task holds at once, as posting lists of row numbers that are intersected and united as the query says. Rules without
mandatory trigrams scan every text. Every candidate is verified with the expression itself, over the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as K
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_column, unused

#: Alternatives of a literal run that are followed; beyond it the run is left out of the query, which stays correct.
MOST_STRINGS = 128
FOUND = "array<struct<kind: string, start: int, end: int>>"


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost and non-overlapping; those whose group is shorter than least code points are dropped. finder, if
    given, is a function of (compiled pattern, text) to the same matches, for patterns that a plain search would try from each place of a
    long run."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0
    finder: Callable[[re.Pattern, str], Iterator[re.Match]] | None = None


TOKEN_RUN = re.compile(r"[A-Za-z0-9_-]+")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")


def token_matches(compiled: re.Pattern, text: str) -> Iterator[re.Match]:
    """Matches that begin with eyJ in a run of token characters. If the first eyJ of a run fails, so do the run's others: what
    follows the run is the same, and they have less of it."""
    at = text.find("eyJ")
    while at >= 0:
        found = compiled.match(text, at)
        if found:
            yield found
        at = text.find("eyJ", found.end() if found else TOKEN_RUN.match(text, at).end())


def login_matches(compiled: re.Pattern, text: str) -> Iterator[re.Match]:
    """Matches with a scheme before "://": from the first letter of the run of scheme characters that ends there, which the match
    before hasn't taken."""
    end, at = 0, text.find("://")
    while at >= 0:
        first = start = at
        while start > end and text[start - 1] in SCHEME:
            start -= 1
            if text[start].isalpha():
                first = start
        found = compiled.match(text, first) if first < at else None
        if found:
            yield found
            end = found.end()
        else:
            end = max(end, at)  # no match reaches over it
        at = text.find("://", max(at + 3, end))


# The three base kinds of the contract, in its order, then public formats of well-known credentials.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 0, 24),
)
MORE = (
    # To the end line, else over the header lines and base64 that follow; a line break may be written as an escape.
    Rule("pem", r"""-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----|(?:(?:\s|\\[nr])*(?:(?:Proc-Type|DEK-Info|Comment):[^\r\n\\]*|[A-Za-z0-9+/]{16,}={0,2}(?:(?:\r?\n|\\n)[A-Za-z0-9+/]{1,15}(?=[\x20\t]*(?:[\r\n\\]|\Z)))?|[A-Za-z0-9+/]{2,}={1,2}))*)"""),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", finder=token_matches),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("login", r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@]+:[^\s/:@]{3,}@", finder=login_matches),
)
RULES = BASE + MORE


def both(parts: list, word: str):
    """parts joined by "and" or "or"; None stands for every text."""
    if word == "or" and None in parts:
        return None
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else (word, tuple(parts))


def of_strings(strings: set[str]):
    """The query of texts that hold one of these strings."""
    return both([both([s[i : i + 3] for i in range(len(s) - 2)], "and") for s in sorted(strings)], "or")


def derive(items) -> tuple[set[str] | None, object]:
    """(the strings that the items match, if they are few, else None; the trigram query they imply, None for every text)."""
    run, whole, parts = {""}, True, []

    def end_run():
        nonlocal run, whole
        parts.append(of_strings(run))
        run, whole = {""}, False

    for what, x in items:
        options: set[str] | None = None
        if what is K.LITERAL:
            options = {chr(x).lower()}
        elif what is K.IN and x[0][0] is not K.NEGATE and all(k in (K.LITERAL, K.RANGE) for k, _ in x):
            members = {chr(c).lower() for k, v in x for c in ([v] if k is K.LITERAL else range(v[0], v[1] + 1))}
            options = members if len(members) <= 8 else None
        elif what in (K.AT, K.ASSERT, K.ASSERT_NOT):
            continue
        elif what is K.SUBPATTERN:
            options, query = derive(x[3])
            parts.append(query if options is None else None)
        elif what is K.BRANCH:
            found = [derive(y) for y in x[1]]
            options = None if any(o is None for o, _ in found) else set().union(*(o for o, _ in found))
            if options is None:
                parts.append(both([q if o is None else of_strings(o) for o, q in found], "or"))
        elif what in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, inner = x
            options, query = derive(inner)
            if (low, high) == (0, 1) and options is not None:
                options = options | {""}
            elif low == high and options is not None and len(options) == 1:
                options = {next(iter(options)) * low}
            else:
                parts.append((query if options is None else of_strings(options)) if low else None)
                options = None
        if options is None or len(run) * len(options) > MOST_STRINGS:
            end_run()
            run = options if options is not None else {""}
        else:
            run = {a + b for a in run for b in options}
    strings = run if whole else None
    parts.append(of_strings(run))
    return strings, both(parts, "and")


def trigram_query(rule: Rule):
    """Nested ("and" or "or", parts) over trigrams of lower-case text, one trigram, or None: the rule scans every text."""
    return derive(parser.parse(rule.pattern, rule.flags | re.ASCII))[1]


def trigrams_of(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


class Index:
    """Posting lists of one segment: for each wanted trigram, the numbers of the texts that hold it, ascending."""

    def __init__(self, wanted: set[str]):
        self.wanted = sorted(w for w in wanted if w.isascii())
        self.slot = np.zeros(1 << 24, dtype=np.uint8 if len(self.wanted) < 256 else np.uint16)
        for k, w in enumerate(self.wanted, 1):
            a, b, c = w.encode()
            self.slot[a << 16 | b << 8 | c] = k
        self.postings: dict[str, np.ndarray] = {}

    def build(self, texts: list[str]) -> None:
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        ends = np.cumsum([len(r) + 1 for r in raw])
        data = np.frombuffer(b"\xff".join([*raw, b""]), dtype=np.uint8).astype(np.uint32)  # no trigram spans two texts
        found = self.slot[data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]] if len(data) > 2 else self.slot[:0]
        at = np.flatnonzero(found)
        pairs = np.unique(found[at].astype(np.int64) * (len(texts) + 1) + np.searchsorted(ends, at, side="right"))
        which, row = np.divmod(pairs, len(texts) + 1)
        cuts = np.searchsorted(which, np.arange(1, len(self.wanted) + 2))
        self.postings = {w: row[cuts[k] : cuts[k + 1]] for k, w in enumerate(self.wanted)}
        self.all = np.arange(len(texts))

    def rows(self, query) -> np.ndarray:
        """Numbers of the texts that satisfy the query."""
        if query is None:
            return self.all
        if isinstance(query, str):
            return self.postings.get(query, self.all)  # a trigram that isn't indexed excludes nothing
        word, parts = query
        out = self.rows(parts[0])
        for p in parts[1:]:
            out = np.intersect1d(out, self.rows(p), assume_unique=True) if word == "and" else np.union1d(out, self.rows(p))
        return out


def matches(rule: Rule, compiled: re.Pattern, text: str):
    for m in rule.finder(compiled, text) if rule.finder else compiled.finditer(text):
        if m.end(rule.group) - m.start(rule.group) >= rule.least:
            yield m.start(), m.end()


def secret_spans(text="text", rules: tuple[Rule, ...] = RULES):
    """A struct column with found: FOUND, all rules' matches by start, then in the rules' order. A null text has none."""
    queries = [trigram_query(r) for r in rules]

    def make():
        compiled = [re.compile(r.pattern, r.flags | re.ASCII) for r in rules]
        index = Index(set().union(*map(trigrams_of, queries)))

        def apply(texts):
            texts = [t or "" for t in texts]
            index.build(texts)
            hits: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
                for i in index.rows(query).tolist():
                    hits[i] += [(start, k, end) for start, end in matches(rule, compiled[k], texts[i])]
            flat = [h for x in hits for h in sorted(x)]
            items = pa.StructArray.from_arrays([pa.array([rules[k].kind for _, k, _ in flat], pa.string()), pa.array([s for s, _, _ in flat], pa.int32()), pa.array([e for _, _, e in flat], pa.int32())], names=["kind", "start", "end"])
            return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in hits])]), pa.int32()), items)]

        return apply

    return text_column(make, f"found {FOUND}")(text)


def joined(found):
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digests of the base kinds, and all spans, for every row of docs.

    Null and empty texts have no spans; repeated rows are reported alike; spans that begin together are in the rules' order; an empty
    table gives no rows; a text of any length is searched whole, in time in proportion to it; other columns are left out.
    """
    base = [r.kind for r in BASE]
    found = docs.select("doc_id", secret_spans(docs["text"]).alias("s")).select("doc_id", F.col("s.found").alias("found"))
    of = lambda kinds: F.filter("found", lambda s: s["kind"].isin(kinds))
    return found.select("doc_id", *(F.size(of([k])).cast("long").alias(f"n_{k}") for k in base), F.sha2(joined(of(base)), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[redacted]") -> DataFrame:
    """docs with every span of its texts replaced by a mark (overlapping spans by one) and n_chars, where there is one, set anew.

    Null texts stay null, repeated rows are treated alike, long texts whole; an empty table gives no rows.
    """

    def make():
        def apply(texts, spans):
            for text, found in zip(texts, spans, strict=True):
                if not found or text is None:
                    yield text
                    continue
                out, at = [], 0
                for s in found:
                    if s["start"] >= at:
                        out += [text[at : s["start"]], mark]
                    at = max(at, s["end"])
                yield "".join([*out, text[at:]])

        return apply

    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array(make()(texts.to_pylist(), spans.to_pylist()), pa.string())

    name = unused(docs)
    marked = docs.withColumn(name, secret_spans(docs["text"])["found"])
    text = F.when(F.size(name) > 0, F.arrow_udf(run, returnType="string")("text", name)).otherwise(F.col("text"))
    out = marked.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(name) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
