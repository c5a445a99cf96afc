"""From lines to parts, questions and speeches.

Single passes over a sitting become running sums over its lines: every function here windows by document and position alone, so
a chain of them needs one shuffle. A document's lines must fit in a task; the corpus may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.html import blocks, is_styled_heading
from ..functions.text import is_caps, is_part_header, is_procedural, is_section_heading, speaker_dialogue, strip_ws
from .numbering import numbered_within


def upto(doc: str, pos: str = "pos") -> WindowSpec:
    """A document's lines up to this one."""
    return Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)


def running(flag: Column, w: WindowSpec) -> Column:
    return F.sum(F.coalesce(flag, F.lit(False)).cast("int")).over(w)


def joined(pos: str, text: str, by: str = "\n") -> Column:
    """Texts of a group in order of position."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))), lambda s: s["t"]), by)


def sectionize(lines: DataFrame, doc: str, line: str = "line") -> DataFrame:
    """(doc, part_no, title, n_lines, content): a header opens a part; what stands before the first is part 0, without title."""
    numbered = lines.withColumn("header", is_part_header(line)).withColumn("part_no", running(F.col("header"), upto(doc)))
    return numbered.groupBy(doc, "part_no").agg(F.min(F.when(F.col("header"), strip_ws(line))).alias("title"), F.count(F.lit(1)).alias("n_lines"), joined("pos", line).alias("content"))


def merge_headings(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, first_pos, tag, style, text): neighbouring headings of one tag and style are one."""
    rows = pages.select(key, F.posexplode(blocks("html")).alias("pos", "b")).select(key, "pos", "b.*").withColumn("heading", is_styled_heading("tag", "style", "text"))
    order = Window.partitionBy(key).orderBy("pos")
    same = F.lag("heading").over(order) & (F.lag("tag").over(order) == F.col("tag")) & (F.lag("style").over(order) == F.col("style"))
    runs = rows.withColumn("fresh", F.col("heading") & ~F.coalesce(same, F.lit(False))).withColumn("run", running(F.col("fresh"), upto(key)))
    return runs.where("heading").groupBy(key, "run").agg(F.min("pos").alias("first_pos"), F.min("tag").alias("tag"), F.min("style").alias("style"), joined("pos", "text", " ").alias("text")).drop("run")


def sectionize_questions(lines: DataFrame, doc: str, line: str = "line") -> DataFrame:
    """(doc, question_no, title, n_lines): QUESTIONS opens the mode, another line of capitals ends it; within it every other heading
    opens a question."""
    text = strip_ws(line)
    caps = is_part_header(line)
    marker = F.when(F.upper(text) == "QUESTIONS", 1).when(caps, 0)
    inside = lines.withColumn("mode", F.coalesce(F.last(marker, ignorenulls=True).over(upto(doc)), F.lit(0)))
    opens = (F.col("mode") == 1) & (F.upper(text) != "QUESTIONS") & ~is_caps(line) & is_section_heading(line)
    numbered = inside.withColumn("opens", opens).withColumn("question_no", running(F.col("opens"), upto(doc)))
    kept = numbered.where((F.col("mode") == 1) & (F.col("question_no") > 0) & (F.upper(text) != "QUESTIONS"))
    return kept.groupBy(doc, "question_no").agg(F.min(F.when(F.col("opens"), text)).alias("title"), F.count(F.lit(1)).alias("n_lines"))


def trim_preamble(lines: DataFrame, doc: str, is_date: Column) -> DataFrame:
    """Lines after the second date; from the first on where there is one; all where there is none."""
    w = Window.partitionBy(doc)
    marked = lines.withColumn("dates", running(is_date, upto(doc))).withColumn("of_all", F.max("dates").over(w)).withColumn("is_date", is_date)
    kept = ((F.col("of_all") >= 2) & (F.col("dates") >= 2) & ~(F.col("is_date") & (F.col("dates") == 2))) | ((F.col("of_all") == 1) & (F.col("dates") >= 1)) | (F.col("of_all") == 0)
    return marked.where(kept).drop("dates", "of_all", "is_date")


def speech_blocks(lines: DataFrame, doc: str, line: str = "line") -> DataFrame:
    """(doc, block, speaker, n_lines, speech): a speaker opens a block; the next one, a heading or a procedural line closes it.
    Lines without an open speaker and blocks without text are left out."""
    heading = is_section_heading(line)
    said = lines.withColumn("s", F.when(~heading, speaker_dialogue(line)))
    opens = F.col("s.speaker").isNotNull()
    closes = heading | (~opens & is_procedural(line))
    blocks_ = said.withColumns({"opens": F.coalesce(opens, F.lit(False)), "closes": closes}).withColumn("block", running(F.col("opens") | F.col("closes"), upto(doc)))
    text = F.when(F.col("opens"), F.col("s.dialogue")).otherwise(strip_ws(line))
    grouped = blocks_.withColumn("text", text).where(~F.col("closes") & (F.col("block") > 0)).groupBy(doc, "block")
    out = grouped.agg(F.min(F.when(F.col("opens"), F.col("s.speaker"))).alias("speaker"), F.count_if(F.col("text") != "").alias("n_lines"), joined("pos", "text").alias("speech"))
    return out.where("speaker is not null and n_lines > 0")


def question_boundaries(lines: DataFrame, doc: str, line: str = "line", ahead: int = 4, asking: str = P.ASKING) -> DataFrame:
    """(doc, question_no, first_pos, n_lines): a speaker in whose next lines someone asks opens a question."""
    near = Window.partitionBy(doc).orderBy("pos").rowsBetween(0, ahead)
    opens = strip_ws(line).rlike(P.QUESTION_SPEAKER) & F.array_join(F.collect_list(line).over(near), " ").rlike(asking)
    numbered = lines.withColumn("opens", opens).withColumn("question_no", running(F.col("opens"), upto(doc)))
    return numbered.where("question_no > 0").groupBy(doc, "question_no").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_lines"))


def split_questions(lines: DataFrame, doc: str, line: str = "line", whole_word: bool = False) -> DataFrame:
    """(doc, number, kind, n_lines): a question number opens a question; what stands before is question 0. A question is oral if
    the word stands in it anywhere, also inside another (whole_word asks for the word itself)."""
    numbered = lines.withColumn("number", running(F.col(line).rlike(P.QUESTION_START), upto(doc)))
    oral = F.lower(line).rlike(r"\boral\b") if whole_word else F.lower(line).contains("oral")
    return numbered.groupBy(doc, "number").agg(F.when(F.max(oral.cast("int")) == 1, "oral").otherwise("written").alias("kind"), F.count(F.lit(1)).alias("n_lines"))


def question_items(lines: DataFrame, doc: str, line: str = "line") -> DataFrame:
    """(doc, pos, section, number, title, reference): numbered titles over five characters within a section of oral or written
    questions, each with the last reference that follows it."""
    text = strip_ws(line)
    section = F.when(text.rlike(r"(?i)^Oral Questions?$"), "oral").when(text.rlike(r"(?i)^Written Questions?$"), "written")
    title = F.regexp_replace(F.regexp_replace(strip_ws(F.regexp_extract(text, P.QUESTION_ITEM, 2)), r"\s+", " "), r"[ –—-]+$", "")
    rows = lines.withColumn("section", F.last(section, ignorenulls=True).over(upto(doc)))
    is_item = F.col("section").isNotNull() & section.isNull() & text.rlike(P.QUESTION_ITEM) & (F.length(title) > 5)
    rows = rows.withColumn("is_item", is_item).withColumn("item", running(F.col("is_item"), upto(doc)))
    reference = F.when(F.col("section").isNotNull() & ~F.col("is_item"), F.nullif(F.regexp_extract(text, P.QUESTION_REFERENCE, 1), F.lit("")))
    rows = rows.withColumns({"number": F.when(F.col("is_item"), F.regexp_extract(text, P.QUESTION_ITEM, 1)), "title": F.when(F.col("is_item"), title), "reference": reference})
    first = rows.where("item > 0").groupBy(doc, "item")
    return first.agg(F.min(F.when(F.col("is_item"), F.col("pos"))).alias("pos"), F.min(F.when(F.col("is_item"), F.col("section"))).alias("section"), F.min("number").alias("number"), F.min("title").alias("title"), F.max_by("reference", F.when(F.col("reference").isNotNull(), F.col("pos"))).alias("reference")).drop("item")


def number_by_type(docs: DataFrame, sitting: str, kind: str, order: str) -> DataFrame:
    """A running number of each kind of question in a sitting, by an integer column."""
    return numbered_within(docs, [sitting, kind], order, "number")


def contents_ordinal(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, title, ord): a heading h2 moves the ordinal on by 100, a list item by 1; of equal titles the last counts."""
    rows = pages.select(key, F.posexplode(blocks("html")).alias("pos", "b")).select(key, "pos", "b.*").where(F.col("tag").isin("h2", "li"))
    ranked = rows.withColumn("ord", F.sum(F.when(F.col("tag") == "h2", 100).otherwise(1)).over(upto(key)))
    return ranked.groupBy(key, F.col("text").alias("title")).agg(F.max("ord").alias("ord"))
