"""Small cases of column functions, one for each known trap."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from rostrum.functions import dates, html, speakers, text
from rostrum.operators import corpus, numbering, search, sections


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize("meta, names", [
    ("Part 1 Speakers:\nSpeaker 1: HON. A\nSpeaker 2: MR B\n\n", ["HON. A", "MR B"]),
    ("Part 6 Speakers:\nNo speakers identified\n", []),
    ("Part 6 Speakers:\nSpeaker 1: No speakers identified\n", []),
    ("Oral Question 1 Speakers:\n", []),
    ("P Speakers:\nSpeaker 1: A: B\n", ["A"]),
    ("", []),
])
def test_metadata(spark, meta, names):
    assert one(spark, meta, speakers.parsed("x")) == names


def test_metadata_round_trip(spark):
    df = spark.createDataFrame([("a/part3.html", ["X", "Y"]), ("a/oral_question_1.html", [])], "path string, names array<string>")
    rows = df.select("names", speakers.rendered("path", "names").alias("m")).select("names", "m", speakers.parsed("m").alias("back")).collect()
    assert all(r["names"] == r["back"] for r in rows)
    assert [r["m"].split("\n")[0] for r in rows] == ["Part 3 Speakers:", "Oral Question Speakers:"]


@pytest.mark.parametrize("path, want", [
    ("/app/collections/A B/2025/Feb/24/part3.html", date(2025, 2, 24)),
    ("/app/collections/A/2023/March/5/part2_questions/oral_question_1.html", date(2023, 3, 5)),
    ("/app/collections/A/2023/Sept/5/part2.html", date(2023, 9, 5)),
    ("/app/collections/A/2023/February/31/part2.html", None),
    ("/app/collections/A/undated/part2.html", None),
])
def test_path_date(spark, path, want):
    assert one(spark, path, dates.path_date("x")) == want


@pytest.mark.parametrize("name, want", [("DAY-40-Wed-21-May-25.html", date(2025, 5, 21)), ("Wednesday-3-March-1999.html", date(1999, 3, 3)), ("notes.html", None)])
def test_filename_date(spark, name, want):
    assert one(spark, name, dates.filename_date("x")) == want


@pytest.mark.parametrize("value, want", [("Sitting of Monday, 22nd March, 2021 at", date(2021, 3, 22)), ("on March 2, 2021", date(2021, 3, 2)), ("none", None)])
def test_text_date(spark, value, want):
    assert one(spark, value, dates.text_date("x")) == want


@pytest.mark.parametrize("now, period, want", [
    (date(2023, 3, 31), "month", date(2023, 3, 3)),
    (date(2024, 3, 31), "month", date(2024, 3, 2)),
    (date(2024, 2, 29), "year", date(2023, 3, 1)),
    (date(2024, 1, 1), "week", date(2023, 12, 25)),
])
def test_periods_roll_over(spark, now, period, want):
    assert spark.range(1).select(dates.range_start(now, period).alias("d")).first()["d"] == want


def test_path_source(spark):
    assert one(spark, "/x/collections/Fi ji/2020", dates.path_source("x")) == "Fi ji"
    assert one(spark, "/x/2020", dates.path_source("x")) == "Unknown Source"


def test_strip_takes_all_white_space(spark):
    assert one(spark, "\t  a b\n", text.strip_ws("x")) == "a b"


@pytest.mark.parametrize("line, plain, strong, short", [
    ("HON. A. MEMBER: yes", True, True, False),
    ("hon. a. member: yes", True, True, False),
    ("HON. A. MEMBER.-", True, True, True),
    ("MADAM SPEAKER.-", True, True, True),
    ("the house met", False, False, False),
])
def test_speaker_lines(spark, line, plain, strong, short):
    assert [one(spark, line, text.is_speaker_line("x", s)) for s in ("plain", "strong", "short")] == [plain, strong, short]


def test_dialogue(spark):
    assert tuple(one(spark, "MR. SMITH: I rise.", text.speaker_dialogue("x"))) == ("MR. SMITH", "I rise.")
    assert tuple(one(spark, "I rise.", text.speaker_dialogue("x"))) == (None, "I rise.")


@pytest.mark.parametrize("line, loose, strict", [("short line of letters", True, False), ("ADJOURNMENT", True, True), ("Question No. 5 on roads", True, True), ("A line, with a comma", False, False)])
def test_headings(spark, line, loose, strict):
    assert one(spark, line, text.is_section_heading("x")) is loose
    assert one(spark, line, text.is_section_heading("x", strict=True)) is strict


def test_sentences_join_abbreviations(spark):
    assert one(spark, "I ask Mr. Smith. He knows. Yes", text.sentences("x")) == ["I ask Mr.", "Smith.", "He knows.", "Yes"]
    assert one(spark, "Good. I ask Mr. Smith.", text.sentences("x")) == ["Good. I ask Mr.", "Smith."]


def test_paragraphs(spark):
    assert one(spark, "a  b\n\nc", text.paragraphs("x")) == ["a", "b", "c"]
    long = " ".join(f"Sentence number {k} goes on for a while and then some more words come." for k in range(10))
    assert [p.count("Sentence") for p in one(spark, long, text.paragraphs("x"))] == [3, 3, 3, 1]
    assert one(spark, "short. Text", text.paragraphs("x")) == ["short. Text"]


def test_spacing(spark):
    assert one(spark, "a , b.C", text.fix_punctuation("x")) == "a, b. C"
    assert one(spark, "a<br>b<br/>c <br> .", text.fix_breaks("x")) == "a b c <br> ."


@pytest.mark.parametrize("page, want", [
    ("<title>Oral Question 1</title><h3>H</h3>", "Oral Question 1"),
    ("<title>T</title><h3> H <b>x</b></h3>", "H x"),
    ("<title>T</title>", "T"),
    ("<p>nothing</p>", "Untitled Document"),
])
def test_titles(spark, page, want):
    assert one(spark, page, html.page_title("x")) == want


def test_plain_text(spark):
    assert one(spark, "<script>a<b</script><p>x&amp;lt;</p><!-- c --><p>y&nbsp;z</p>", html.html_text("x")) == "x&lt; y z"


@pytest.mark.parametrize("tag, style, label, want", [("h2", "", "anything", True), ("h3", "padding-left: 120pt", "x", True), ("h3", "padding-left: 20pt", "x", False), ("p", "text-align: center", "x", True), ("h3", "", "Title Case", True), ("h3", "", "Hon. Name", False), ("h3", "", "12", False)])
def test_styled_heading(spark, tag, style, label, want):
    df = spark.createDataFrame([(tag, style, label)], "t string, s string, x string")
    assert df.select(html.is_styled_heading("t", "s", "x").alias("y")).first()["y"] is want


def test_links(spark):
    def link(name, label, around=""):
        df = spark.createDataFrame([(name, label, around)], "n string, l string, p string")
        return tuple(df.select(html.is_transcript_link("n", "l", "p"), html.link_date_label("n", "l", "p")).first())

    assert link("DAY-1.pdf", "x") == (True, "x")
    assert link("Mon-22-March-2021.pdf", "") == (True, "Mon 22 March 2021")
    assert link("a.pdf", "here", "Sitting Day 3: 5 May here") == (True, "5 May")
    assert link("travel-Monday.pdf", "Monday") == (False, "Monday")


def lines(spark, *rows):
    return spark.createDataFrame([(1, k, r) for k, r in enumerate(rows)], "doc int, pos int, line string")


def test_first_form_of_a_name_stays(spark):
    df = lines(spark, "HON. A. BROWN: yes. HON. A.  BROWN: no", "MR SPEAKER: order", "CLERK ASSISTANT: read")
    assert speakers.speakers(df, "doc", "pos", "line", "colon").first()["speakers"] == ["A. BROWN", "CLERK", "HON. A. BROWN", "MR SPEAKER"]  # the general pattern takes the title along


def test_parts_keep_every_line(spark):
    df = lines(spark, "before", "PRAYER", "a", "b", "BILLS AND PAPERS", "c")
    parts = sections.sectionize(df, "doc").orderBy("part_no").collect()
    assert [(p["part_no"], p["title"], p["n_lines"]) for p in parts] == [(0, None, 1), (1, "PRAYER", 3), (2, "BILLS AND PAPERS", 2)]
    assert "\n".join(p["content"] for p in parts) == "before\nPRAYER\na\nb\nBILLS AND PAPERS\nc"


def test_sectioning_shuffles_once(spark):
    plan = sections.sectionize(lines(spark, "A").repartition(3), "doc")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_speeches(spark):
    df = lines(spark, "lost, no speaker yet", "HON. A. B: first,", "second.", "Question put.", "lost, too", "MR. CO: third.", "HON. D. E:", "MADAM FI: fourth, with a comma")
    got = [(r["speaker"], r["speech"]) for r in sections.speech_blocks(df, "doc").orderBy("block").collect()]
    assert got == [("HON. A. B", "first,\nsecond."), ("MR. CO", "third."), ("MADAM FI", "fourth, with a comma")]


def test_oral_is_a_substring(spark):
    df = lines(spark, "Question No. 1", "electoral matters", "Question No. 2", "roads")
    assert [r["kind"] for r in sections.split_questions(df, "doc").orderBy("number").collect()] == ["oral", "written"]
    assert [r["kind"] for r in sections.split_questions(df, "doc", whole_word=True).orderBy("number").collect()] == ["written", "written"]


def test_question_items_take_the_last_reference(spark):
    df = lines(spark, "(1) Before any section", "Oral Questions", "(1) Roads and bridges - ", "(Q/No. 5/2024)", "(2) abc", "Written Questions", "(3) Schools in the north")
    got = [tuple(r[c] for c in ("section", "number", "title", "reference")) for r in sections.question_items(df, "doc").orderBy("pos").collect()]
    assert got == [("oral", "1", "Roads and bridges", "5/2024"), ("written", "3", "Schools in the north", None)]


def test_question_boundaries(spark):
    df = lines(spark, "intro", "HON. A. B: I ask the minister", "text", "MR. C: thanks", "x", "x", "x", "x", "MR. D: a question", "end")
    assert [r["first_pos"] for r in sections.question_boundaries(df, "doc").orderBy("question_no").collect()] == [1, 8]


def test_preamble(spark):
    def kept(*rows):
        return [r["line"] for r in sections.trim_preamble(lines(spark, *rows), "doc", F.col("line") == "D").orderBy("pos").collect()]

    assert kept("a", "D", "b", "D", "c", "D") == ["c", "D"]
    assert kept("a", "D", "b") == ["D", "b"]
    assert kept("a", "b") == ["a", "b"]


GOLDEN = "modern boolean, speakers long, questions long"
#: Speakers and questions of a real batch of sittings, newer and older.
NEWER = [(13, 13), (28, 34), (20, 30), (24, 28), (9, 29), (13, 15)]
OLDER = [26, 24, 20, 16, 8, 18, 14, 21, 19, 22, 19, 12, 19, 24, 23, 19, 5]


def test_batch_summary(spark):
    df = spark.createDataFrame([(True, *x) for x in NEWER] + [(False, s, 0) for s in OLDER], GOLDEN)
    assert tuple(corpus.batch_summary(df).first()) == (23, 416, 149, 18.1, 6.5, 6, 26.1)
    means = {r["modern"]: (round(r["s"], 1), round(r["q"], 1)) for r in df.groupBy("modern").agg(F.avg("speakers").alias("s"), F.avg("questions").alias("q")).collect()}
    assert means == {True: (17.8, 24.8), False: (18.2, 0.0)}
    best = corpus.best_worst(df.withColumn("k", F.monotonically_increasing_id()), "speakers", "k").first()
    assert (best["most"], best["least"]) == (28, 5)


def test_batch_summary_of_nothing(spark):
    r = corpus.batch_summary(spark.createDataFrame([], GOLDEN)).first()
    assert (r["files"], r["share"]) == (0, None)


def docs(spark):
    rows = [(k, f"Title {k}", date(2024, 1, 1 + k % 28) if k % 4 else None, "s", "HON. A" if k % 2 else None, None, "Oral Question", k % 5, "that with words" if k % 3 else "nothing") for k in range(60)]
    return spark.createDataFrame(rows, "doc_id long, title string, sitting_date date, source string, speaker string, speaker2 string, document_type string, ord int, content string")


def test_all_terms_are_among_any(spark):
    df = docs(spark)
    both = {r["doc_id"] for r in df.where(search.has_terms("content", ("that", "words"))).collect()}
    assert both <= {r["doc_id"] for r in df.where(search.has_terms("content", ("that", "words"), "or")).collect()} and both


def test_keyset_pages_equal_offset_pages(spark):
    df = docs(spark)
    first = search.page(df, 0, 20).collect()
    last = [r for r in first if r["sitting_date"]][-1]
    assert [r["doc_id"] for r in search.page_after(df, last["sitting_date"], last["ord"], last["doc_id"], 20).collect()] == [r["doc_id"] for r in search.page(df, 20, 20).collect()]


def test_facets_add_up(spark):
    df = docs(spark)
    got = search.field_facets(df, ("document_type", "source")).groupBy("field").agg(F.sum("n").alias("n")).collect()
    assert {r["n"] for r in got} == {60}


def test_highlight_marks_terms(spark):
    assert one(spark, "x" * 300 + " that is THAT", search.highlights(F.col("x"), ("that",))) == ["x" * 50 + " <em>that</em> is <em>THAT</em>"]


def test_numbers_over_ranges(spark):
    rows = [(s, i) for s in ("a", "b", None) for i in (-7, -1, 0, 3, 4, 9, 40)] + [("a", None), ("a", 41)]
    df = spark.createDataFrame(rows, "Range_Of string, i int")
    found = numbering.numbered_within(df, ["Range_Of"], "i", "k", width=4)
    want = {}
    for s in ("a", "b", None):
        values = sorted((i for t, i in rows if t == s), key=lambda i: (i is not None, i or 0))
        want |= {(s, i): k for k, i in enumerate(values, 1)}
    assert {(s, i): k for s, i, k in found.collect()} == want and found.columns == ["Range_Of", "i", "k"]
    assert numbering.numbered_within(df.limit(0), ["Range_Of"], "i", "k").count() == 0
