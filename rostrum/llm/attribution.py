"""Token counts by offset-mapped attribution: whole documents are encoded once, and each token's character span is joined to the
sections it overlaps.

The rule for tokens that cross a boundary: a token belongs to the section that holds most of its characters, to the earlier one
if two hold as many; a token of no characters belongs where it starts. Sections are taken by start, then end; where two overlap,
the earlier holds the shared characters. Tokens outside all sections are counted as rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import slices, text_column
from .tokens import WordTokens

SPANS = "array<struct<start: int, end: int>>"
COUNTS = "doc_tokens long, rest long, counts array<struct<section: int, start: int, end: int, n_tokens: long, n_split: long>>"
LONGEST = 1000
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def line_sections(text="text", longest: int = LONGEST):
    """A column of SPANS: the text's lines, each with the \\n that ends it, cut after so many code points; one for an empty text."""

    def make():
        def of(text):
            at, out = 0, []
            for line in lines(text or ""):
                out += [(k, min(k + longest, at + line)) for k in range(at, at + line, longest)]
                at += line
            return out or [(0, 0)]

        def lines(text):
            at = 0
            while at < len(text):
                end = text.find("\n", at) + 1 or len(text)
                yield end - at
                at = end

        return lambda texts: [list(map(of, texts))]

    return text_column(make, f"spans {SPANS}")(text)["spans"]


def word_starts(data: bytes) -> np.ndarray:
    """Where the words between ASCII white space begin, in code points."""
    raw = np.frombuffer(data, dtype=np.uint8)
    space = SPACE[raw]
    begin = np.flatnonzero(~space & np.concatenate([[True], space])[:-1])
    return begin if data.isascii() else (np.cumsum((raw & 0xC0) != 0x80) - 1)[begin]


def clipped(spans: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sections by start and end as disjoint intervals, and their numbers in the given order."""
    starts = np.array([s["start"] for s in spans], dtype=np.int64)
    ends = np.array([s["end"] for s in spans], dtype=np.int64)
    order = np.lexsort((ends, starts))
    starts, ends = starts[order], ends[order]
    before = np.concatenate([[0], np.maximum.accumulate(ends)[:-1]]) if len(ends) else ends
    starts = np.maximum(starts, before)
    return starts, np.maximum(ends, starts), order


def attribute(begin: np.ndarray, end: np.ndarray, spans: list[dict]) -> tuple[int, np.ndarray, np.ndarray]:
    """The interval join of tokens (begin and end of each, in code points, by begin) and sections: the tokens in no section, and for
    each section, in the given order, its tokens and those of them that cross a boundary."""
    n = len(spans)
    counts, split = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    if not n:
        return len(begin), counts[:0], split[:0]
    starts, ends, order = clipped(spans)
    # the last section that starts at or before the token; of those that start together the last is the one that isn't empty
    first = np.searchsorted(starts, begin, side="right") - 1
    whole = (first >= 0) & (end <= ends[np.maximum(first, 0)]) & (end > begin)
    counts[:n] += np.bincount(first[whole], minlength=n)
    for i in np.flatnonzero(~whole).tolist():
        a, b = int(begin[i]), int(end[i])
        k = max(0, int(first[i]))
        best, most, held, touched = n, 0, 0, 0
        while k < n and starts[k] < max(b, a + 1):
            shared = int(min(b, ends[k]) - max(a, starts[k])) if b > a else int(starts[k] <= a < ends[k])
            if shared > 0:
                held, touched = held + shared, touched + 1
                if shared > most:
                    best, most = k, shared
            k += 1
        counts[best] += 1
        split[best] += touched > 1 or 0 < held < b - a
    back = np.empty(n, dtype=np.int64)
    back[order] = np.arange(n)
    return int(counts[n]), counts[back], split[back]


def token_spans(data: bytes, entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each of a document's tokens, from its bytes and its words' entries (WordTokens with spans)."""
    inside = np.frombuffer(b"".join(entries), dtype=np.int32).reshape(-1, 2)
    tokens = np.fromiter(map(len, entries), dtype=np.int64, count=len(entries)) >> 3
    at = np.repeat(word_starts(data), tokens)
    return at + inside[:, 0], at + inside[:, 1]


def token_counts(text, spans, path: str | None = None):
    """A struct column (COUNTS) for a text column and a column of SPANS; null texts are empty, null spans none."""
    kind = StructType.fromDDL(COUNTS)
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in kind.fields]

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        words = WordTokens(path, spans=True)
        for texts, sections in batches:
            at, parts = 0, []
            for part in slices(texts):
                values, own = part.to_pylist(), sections.slice(at, len(part)).to_pylist()
                at += len(part)
                rows = []
                for text, entries, spans in zip(values, words.of(values), own, strict=True):
                    spans = spans or []
                    begin, end = token_spans((text or "").encode("utf-8", "replace"), entries)
                    rest, counts, split = attribute(begin, end, spans)
                    rows.append((len(begin), rest, [(k, s["start"], s["end"], c, x) for k, (s, c, x) in enumerate(zip(spans, counts.tolist(), split.tolist(), strict=True))]))
                columns = list(zip(*rows, strict=True))
                parts.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(fields))

    return F.arrow_udf(run, returnType=kind)(text, spans)


def section_report(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """One row for each section of each document: doc_id, section, start, end, n_tokens, n_split, doc_tokens.

    Null and empty texts have one empty section; repeated rows are reported alike; a token that lies half in one section and half in
    the next belongs to the earlier; a long text is held whole by one task, as one token list; an empty table gives no rows; other
    columns are left out.
    """
    # inline_outer, as no array is empty: for inline the optimizer would add a filter on the arrays and run both functions twice
    found = docs.select("doc_id", token_counts(docs["text"], line_sections(docs["text"], longest)).alias("t"))
    return found.select("doc_id", "t.doc_tokens", F.inline_outer("t.counts")).select("doc_id", "section", "start", "end", "n_tokens", "n_split", "doc_tokens")
