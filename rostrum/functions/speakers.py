"""Who speaks: names from lines of transcripts, and from the metadata files beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import NO_SPEAKER
from . import patterns as P
from .text import col, normalize_name, strip_ws


def clean_colon(name: Column) -> Column:
    name = strip_ws(F.regexp_replace(F.regexp_replace(strip_ws(name), r":+$", ""), r"\.+$", ""))
    return F.when(name == "SPEAKER", "MR SPEAKER").when(name.startswith("CLERK"), "CLERK").otherwise(name)


def clean_dash(name: Column) -> Column:
    name = strip_ws(F.regexp_replace(strip_ws(name), r"[.\-:]+$", ""))
    return F.when(name.contains("SPEAKER") & ~name.rlike("DEPUTY|ASSISTANT"), "MR SPEAKER").otherwise(name)


def clean_titled(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip_ws(name), r"\.+$", ""), r":+$", "")


def clean_paragraph(name: Column) -> Column:
    return strip_ws(F.regexp_replace(strip_ws(name), r"-+$", ""))


#: style: (patterns, cleaning, whether names of one or two letters and bare marks are noise, order of "first seen")
STYLES = {
    "colon": (P.SPEAKERS_COLON, clean_colon, True, ("pattern", "pos", "at")),
    "dash": (P.SPEAKERS_DASH, clean_dash, True, ("pos", "pattern", "at")),
    "titled": (P.SPEAKERS_TITLED, clean_titled, False, ("pattern", "pos", "at")),
    "paragraph": (((P.SPEAKER_PARAGRAPH, 0, 1),), clean_paragraph, False, ("pos", "pattern", "at")),
}


def found_in(line, style: str) -> Column:
    """array<struct<pattern, at, name>> of all matches of a style's patterns in a line: one projection, one scan."""
    patterns, clean = STYLES[style][:2]

    def of(k: int, pattern: str, title: int, name: int) -> Column:
        names = F.regexp_extract_all(col(line), F.lit(pattern), F.lit(name))
        if title:
            titles = F.regexp_extract_all(col(line), F.lit(pattern), F.lit(title))
            names = F.zip_with(titles, names, lambda t, n: F.when((F.coalesce(t, F.lit("")) == "") | ((t == "HON.") if style == "colon" else F.lit(False)), n).otherwise(F.concat_ws(" ", t, n)))
        return F.transform(names, lambda n, at: F.struct(F.lit(k).alias("pattern"), at.alias("at"), clean(n).alias("name")))

    return F.concat(*(of(k, *p) for k, p in enumerate(patterns)))


def speakers(lines: DataFrame, document: str, pos: str, line: str, style: str, keep_order: bool = False) -> DataFrame:
    """(document, speakers): the first form of each name, told apart without spaces and case, sorted or in order of appearance.

    Names are grouped by document and name before any list is made, so a list is no longer than a document has speakers.
    """
    order = STYLES[style][3]
    found = lines.select(document, F.col(pos).alias("pos"), F.explode(found_in(line, style)).alias("f")).select(document, "pos", "f.*").withColumn("key", normalize_name("name"))
    found = found.where((F.length("key") > 2) & F.col("key").rlike(r"[^0-9]") & F.col("key").rlike(r"[^.,!?;:-]") if STYLES[style][2] else F.col("key") != "")
    first = found.groupBy(document, "key").agg(F.min(F.struct(*order, "name")).alias("f"))
    listed = F.sort_array(F.collect_list(F.struct(*(f"f.{c}" for c in order), "f.name")))
    names = F.transform(listed, lambda s: s["name"])
    return first.groupBy(document).agg((names if keep_order else F.array_sort(names)).alias("speakers"))


def parsed(meta) -> Column:
    """The speakers of a metadata file's text: of each line after the first what stands between its first and second ': '.

    Both ways of writing that there is none give an empty array.
    """
    lines = F.filter(F.slice(F.split(strip_ws(meta), "\n"), 2, 1 << 30), lambda x: x != "")
    names = F.transform(lines, lambda x: F.try_element_at(F.split(x, ": "), F.lit(2)))
    return F.filter(names, lambda n: n.isNotNull() & (n != NO_SPEAKER))


def speaker_columns(names) -> tuple[Column, Column]:
    """The first and the second speaker, null where there is none."""
    return F.try_element_at(col(names), F.lit(1)), F.try_element_at(col(names), F.lit(2))


def rendered(path, names) -> Column:
    """The text of a metadata file: heading by the path, then numbered speakers or the sentence that there is none."""
    number = F.regexp_extract(col(path), r"part(\d+)", 1)
    heading = F.when(col(path).contains("oral_question"), "Oral Question Speakers:").when(col(path).contains("written_question"), "Written Question Speakers:").when(number != "", F.concat(F.lit("Part "), number, F.lit(" Speakers:"))).otherwise("Speakers:")
    lines = F.transform(col(names), lambda n, k: F.concat(F.lit("Speaker "), (k + 1).cast("string"), F.lit(": "), n))
    body = F.when(F.size(col(names)) > 0, F.array_join(lines, "\n")).otherwise(NO_SPEAKER)
    return F.concat(heading, F.lit("\n"), body, F.lit("\n"))


def is_named(c) -> Column:
    """A speaker that isn't null, empty or the sentence that there is none."""
    return col(c).isNotNull() & (col(c) != "") & (col(c) != NO_SPEAKER)
