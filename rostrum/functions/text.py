"""Column functions on lines and texts of transcripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Without white space and no-break spaces at the ends (trim() takes U+0020 alone)."""
    return F.regexp_replace(col(c), r"^[\s\u00A0]+|[\s\u00A0]+$", "")


def group(c, pattern: str, n: int = 1) -> Column:
    """A group of the first match, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(col(c), pattern, n), F.lit(""))


def tokens(c) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def normalize_name(c) -> Column:
    """A name without white space, in upper case: one person, however it was spaced."""
    return F.upper(F.regexp_replace(col(c), r"\s+", ""))


def is_caps(c) -> Column:
    """At least one letter A-Z and none in lower case."""
    return col(c).rlike("[A-Z]") & (F.upper(col(c)) == col(c))


def is_speaker_line(c, strength: str = "plain") -> Column:
    """strength: plain (a title and a capital), strong (a whole designation), short (a designation and nothing else)."""
    line = strip_ws(c)
    if strength == "short":
        return (F.length(line) <= P.SHORT_LINE) & line.rlike(P.SPEAKER_LINE_SHORT)
    return line.rlike({"plain": P.SPEAKER_LINE, "strong": P.SPEAKER_LINE_STRONG}[strength])


def speaker_dialogue(c) -> Column:
    """struct(speaker, dialogue) of a line by the first pattern that matches; no speaker and the line itself otherwise."""
    line = strip_ws(c)
    out = F.struct(F.lit(None).cast("string").alias("speaker"), col(c).alias("dialogue"))
    for pattern in reversed(P.DIALOGUE):
        out = F.when(line.rlike(pattern), F.struct(strip_ws(F.regexp_extract(line, pattern, 1)).alias("speaker"), strip_ws(F.regexp_extract(line, pattern, 2)).alias("dialogue"))).otherwise(out)
    return out


def is_procedural(c) -> Column:
    return strip_ws(c).rlike(P.PROCEDURAL)


def is_section_heading(c, strict: bool = False) -> Column:
    """A short line that is a heading by its form. Case is ignored, so any short line of letters is one;
    strict asks for capitals there."""
    line = strip_ws(c)
    found = (F.length(line) < P.HEADING_LENGTH) & line.rlike(P.HEADING)
    return found & (is_caps(line) | ~line.rlike(r"(?i)^[A-Z][A-Z\s]+$")) if strict else found


def is_vocabulary_heading(c) -> Column:
    """A line under 100 characters that holds a word of the headings' list, or capitals under 50."""
    return ((F.length(col(c)) < P.HEADING_WORDS_LENGTH) & F.upper(col(c)).rlike(P.HEADING_WORDS)) | ((F.length(col(c)) < P.HEADING_LENGTH) & is_caps(c))


def is_part_header(c) -> Column:
    """Capitals, over three characters, no page mark."""
    line = strip_ws(c)
    return is_caps(line) & (F.length(line) > 3) & ~line.startswith("PAGE")


def is_page_marker(c) -> Column:
    return strip_ws(c).rlike(P.PAGE_MARKER)


def question_section(c) -> Column:
    """oral, written or null; oral where a text is both."""
    return F.when(col(c).rlike(P.ORAL_SECTION), "oral").when(col(c).rlike(P.WRITTEN_SECTION), "written")


def has_questions(c) -> Column:
    return col(c).rlike(P.QUESTION_SECTION)


def fix_punctuation(c) -> Column:
    """No space before a mark, one between a mark and a capital."""
    return F.regexp_replace(F.regexp_replace(col(c), r"\s+([.,;:!?])", "$1"), r"([.,;:!?])([A-Z])", "$1 $2")


def fix_breaks(c) -> Column:
    """A line break between word characters is a space. Twice, as neighbouring hits share a character."""
    once = F.regexp_replace(col(c), r"([A-Za-z0-9])\s*<br ?/?>\s*([A-Za-z0-9])", "$1 $2")
    return F.regexp_replace(once, r"([A-Za-z0-9])\s*<br ?/?>\s*([A-Za-z0-9])", "$1 $2")


def sentences(c) -> Column:
    """Sentences: split after a mark before a capital; a piece that ends in an abbreviation joins the one before it."""
    pieces = F.split(F.regexp_replace(col(c), r"([.!?])\s+([A-Z])", "$1\u0001$2"), "\u0001")

    def add(done: Column, piece: Column) -> Column:
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat_ws(" ", F.element_at(done, -1), piece)))
        return F.when(piece.rlike(P.ABBREVIATION) & (F.size(done) > 0), joined).otherwise(F.concat(done, F.array(piece)))

    return F.aggregate(pieces, F.array().cast("array<string>"), add)


def paragraphs(c, longest: int = 500, most: int = 3) -> Column:
    """Paragraphs of a speech: at blank lines and double spaces; a long text without any by sentences, three at a time or up to
    one that addresses the house."""
    natural = F.split(col(c), r"\s{2,}|\n\n")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"))

    def add(state: Column, s: Column) -> Column:
        now = F.concat(state["open"], F.array(s))
        full = (F.size(now) >= most) | s.rlike(P.ADDRESS)
        return F.when(full, F.struct(F.concat(state["done"], F.array(F.array_join(now, " "))).alias("done"), F.array().cast("array<string>").alias("open"))).otherwise(F.struct(state["done"].alias("done"), now.alias("open")))

    grouped = F.aggregate(sentences(c), start, add, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(F.array_join(s["open"], " ")))).otherwise(s["done"]))
    chosen = F.when((F.size(natural) == 1) & (F.length(col(c)) > longest), grouped).otherwise(natural)
    return F.filter(F.transform(chosen, strip_ws), lambda p: p != "")


def paragraph_class(c) -> Column:
    """speaker, procedural (capitals over 10 characters) or regular."""
    return F.when(col(c).rlike(r"(?i)^(?:HON|MR|DR|MRS|MS)\.\s+[A-Z][A-Z\s.]+:"), "speaker").when((F.upper(col(c)) == col(c)) & (F.length(col(c)) > 10), "procedural").otherwise("regular")
