"""Files: a tree with two sources, short and full months, a deep question, all forms of metadata, a page without any, and a space."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from rostrum.operators import index, ingest
from rostrum.operators import search as S
from rostrum.sources import files
from rostrum.streaming.ingest import retried, watch

PAGE = "<html><head><title>{0}</title></head><body><h3>{0}</h3><p>Text of {0}</p></body></html>"


@pytest.fixture
def tree(tmp_path):
    def put(path, text):
        at = tmp_path / "collections" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text if isinstance(text, bytes) else text.encode())

    put("North Isles/2025/Feb/24/part0.html", PAGE.format("PRAYER"))
    put("North Isles/2025/Feb/24/part0_metadata.txt", "Part 0 Speakers:\nSpeaker 1: HON. A\nSpeaker 2: MR B\n\n")
    put("North Isles/2025/Feb/24/contents.html", "<h2>Contents</h2><ul><li>PRAYER</li><li>BILLS</li><li>PRAYER</li></ul>")
    put("North Isles/2025/Feb/24/part1.html", PAGE.format("LOST"))
    put("South/2023/March/5/part2_questions/oral_question_1.html", PAGE.format("Oral Question 1"))
    put("South/2023/March/5/part2_questions/oral_question_1_metadata.txt", "Oral Question Speakers:\nNo speakers identified\n")
    put("South/2023/March/5/part1.html", PAGE.format("BILLS"))
    put("South/2023/March/5/part1_metadata.txt", "Part 1 Speakers:\nSpeaker 1: No speakers identified\n")
    return tmp_path


def test_pages_and_metadata(spark, tree):
    pages = files.pages(spark, str(tree))
    assert pages.count() == 4 and any("North Isles" in r["path"] for r in pages.collect())
    assert files.metadata(spark, str(tree)).count() == 3
    missing = pages.join(files.metadata(spark, str(tree)), "stem", "left_anti").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in missing] == ["part1.html"]


def table_of(spark, tree, strict=False):
    args = (files.pages(spark, str(tree)), files.metadata(spark, str(tree)), files.contents(spark, str(tree)))
    return {r["path"].rsplit("/", 1)[1]: r for r in ingest.documents(*args, html_sources=("South",), strict=strict).collect()}


def test_documents(spark, tree):
    rows = table_of(spark, tree)
    assert set(rows) == {"part0.html", "oral_question_1.html", "part1.html"}
    first = rows["part0.html"]
    assert (first["source"], str(first["sitting_date"]), first["speaker"], first["speaker2"], first["ord"]) == ("North Isles", "2025-02-24", "HON. A", "MR B", 103)
    oral = rows["oral_question_1.html"]
    assert (oral["title"], oral["document_type"], oral["speaker"], oral["ord"]) == ("Oral Question 1 - 2023-03-05", "Oral Question", None, 9999)
    assert rows["part1.html"]["content"] == "<p>Text of BILLS</p>" and first["content"] == "PRAYER PRAYER Text of PRAYER"
    assert set(table_of(spark, tree, strict=True)) == {"part0.html"}
    assert {k: r["doc_key"] for k, r in table_of(spark, tree).items()} == {k: r["doc_key"] for k, r in rows.items()}


def test_incremental_runs(spark, tree, tmp_path):
    def run(when):
        return ingest.ingest(spark, str(tree / "collections"), str(tmp_path / "t"), str(tmp_path / "s"), when)

    assert run("2024-01-01") == {"new": 4, "processed": 3, "failed": 1, "skipped": 0, "gone": 0, "total": 4}
    assert run("2024-01-02") == {"new": 1, "processed": 0, "failed": 1, "skipped": 3, "gone": 0, "total": 4}
    (tree / "collections/South/2023/March/5/part1.html").write_text(PAGE.format("MOTIONS"))
    assert run("2024-01-03") == {"new": 2, "processed": 1, "failed": 1, "skipped": 2, "gone": 0, "total": 4}
    docs = spark.read.parquet(str(tmp_path / "t"))
    assert docs.count() == 4 and ingest.newest(docs).count() == 3
    late = tree / "collections/North Isles/2025/Feb/24/part1_metadata.txt"  # what failed is tried again
    late.write_text("Part 1 Speakers:\nSpeaker 1: HON. L\n")
    assert run("2024-01-04") == {"new": 1, "processed": 1, "failed": 0, "skipped": 3, "gone": 0, "total": 4}
    assert run("2024-01-05")["skipped"] == 4
    index.rebuild(ingest.newest(spark.read.parquet(str(tmp_path / "t"))), str(tmp_path / "i"))
    (tmp_path / "i/whole-9").mkdir()  # a lost run
    assert index.read(spark, str(tmp_path / "i")).postings.where("term = 'motions'").count() == 1


def test_a_run_reads_its_pages_once(spark, tree, tmp_path, monkeypatch):
    plans = []
    kept = files.kept
    monkeypatch.setattr(files, "kept", lambda rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or kept(rows))
    ingest.ingest(spark, str(tree / "collections"), str(tmp_path / "t"), str(tmp_path / "s"), "2024-01-01")
    scans = [line for line in plans[0].splitlines() if "FileScan text" in line and "html" in line and "contents" not in line]
    assert len(plans) == 1 and plans[0].count("pathGlobFilter=*.html") <= 1 and len(scans) <= 1 and "CollectMetrics" in plans[0]


def test_parts_of_the_state_are_folded(spark, tmp_path, monkeypatch):
    from rostrum.schema import STATE
    from rostrum.sources import versions

    monkeypatch.setattr(ingest, "FOLD", 2)
    at = str(tmp_path / "s")
    for k in range(7):
        ingest.save_state(spark.createDataFrame([("a", f"h{k}"), (f"p{k}", "h")], "file_path string, file_hash string").selectExpr("*", f"timestamp'2024-01-0{k + 1}' indexed_at"), at)
    rows = {r["file_path"]: r["file_hash"] for r in ingest.load_state(spark, at).collect()}
    assert rows == {"a": "h6"} | {f"p{k}": "h" for k in range(7)} and ingest.load_state(spark, at).schema.names == STATE.names
    assert len(versions.finished(spark, at)) < 7 and len(versions.current(spark, at)) <= 2


def found_in(spark, docs, by, **request):
    result = S.search(docs, S.SearchRequest(**request), by, "doc_key")
    return [r["path"] for r in result.page.join(docs.select("doc_key", "path"), "doc_key").orderBy("rank").collect()], result.total.first()["n"]


def test_search_runs_on_what_ingest_writes(spark, tree, tmp_path):
    ingest.ingest(spark, str(tree / "collections"), str(tmp_path / "t"), str(tmp_path / "s"), "2024-01-01")
    docs = spark.read.parquet(str(tmp_path / "t"))
    index.rebuild(docs, str(tmp_path / "i"))
    by = index.read(spark, str(tmp_path / "i"))
    for request, most in (({"terms": ("text", "of")}, 3), ({"terms": ("prayer", "bills"), "mode": "or", "sort": "relevance"}, 2), ({"phrase": "Text of"}, 3), ({"prefix": "pray"}, 1), ({"wildcard": "*ills"}, 1), ({"wildcard": "q?estion"}, 1), ({}, 3)):
        one, other = found_in(spark, docs, None, **request), found_in(spark, docs, by, **request)
        assert one == other and one[1] == len(one[0]) == most, request
    assert found_in(spark, docs, by, terms=("prayer", "text"), mode="or", sort="relevance")[0][0].endswith("part0.html")
    with pytest.raises(ValueError):
        S.search(docs, S.SearchRequest(terms=("text",)), by, "path")


def test_segments_equal_a_rebuild(spark, tree, tmp_path):
    folder, where = tree / "collections", [str(tree / "collections"), str(tmp_path / "t"), str(tmp_path / "s")]
    at = str(tmp_path / "i")
    run = lambda day: ingest.ingest(spark, *where, f"2024-01-0{day}", index=at, deletions=True)
    run(1)
    (folder / "South/2023/March/5/part1.html").write_text(PAGE.format("MOTIONS"))
    (folder / "North Isles/2025/Feb/24/part1_metadata.txt").write_text("Part 1 Speakers:\nSpeaker 1: HON. L\n")
    assert run(2)["processed"] == 2
    (folder / "North Isles/2025/Feb/24/part0.html").unlink()
    (folder / "South/2023/March/5/part7.html").write_text(PAGE.format("BILLS again"))
    (folder / "South/2023/March/5/part7_metadata.txt").write_text("Part 7 Speakers:\nSpeaker 1: HON. M\n")
    assert run(3) == {"new": 1, "processed": 1, "failed": 0, "skipped": 3, "gone": 1, "total": 4}
    assert run(4)["gone"] == 0

    docs = ingest.present(spark.read.parquet(where[1]), ingest.load_state(spark, where[2]))
    index.rebuild(docs, str(tmp_path / "whole"))
    rows = lambda x: sorted((r["term"], r["doc_key"], r["tf"], tuple(r["positions"])) for r in x.postings.collect())
    lengths = lambda x: sorted(tuple(r) for r in x.stats.select("doc_key", "length").collect())
    whole, live = index.read(spark, str(tmp_path / "whole")), index.read(spark, at)
    assert rows(live) == rows(whole) and lengths(live) == lengths(whole) and docs.count() == 4
    for request in ({"terms": ("bills", "motions"), "mode": "or", "sort": "relevance"}, {"terms": ("prayer",)}, {"phrase": "bills again"}, {"prefix": "mot"}, {"wildcard": "*ills"}):
        assert found_in(spark, docs, live, **request) == found_in(spark, docs, whole, **request)
    assert index.merge(spark, at) == 3 and index.merge(spark, at) == 0
    merged = index.read(spark, at)
    assert rows(merged) == rows(whole) and lengths(merged) == lengths(whole)
    assert sorted(tuple(r) for r in merged.terms.collect()) == sorted(tuple(r) for r in whole.terms.collect())
    (folder / "South/2023/March/5/part7.html").write_text(PAGE.format("GONE over"))
    run(5)
    assert index.read(spark, at).postings.where("term = 'again'").count() == 0
    assert index.merge(spark, at) == 2 and len(list((tmp_path / "i").iterdir())) < 5


def test_the_best_are_found_in_few_blocks(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_BITS", 3)
    monkeypatch.setattr(index, "FIRST_BLOCKS", 4)
    rng = random.Random(7)
    rare = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choice(rare if rng.random() < 0.1 else ["the", "of", "and"]) for _ in range(rng.choice([5, 20, 80, 300]))) for _ in range(1500)] + [None, "", "the", "the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string").repartition(3)
    index.rebuild(docs, str(tmp_path / "i"), "doc_id")
    by = index.read(spark, str(tmp_path / "i"), "doc_id")
    order = lambda df, k: [tuple(r) for r in df.orderBy(F.desc("score"), "doc_id").limit(k).collect()]
    fewer = 0
    for terms in (("w1",), ("w1", "w2"), ("w3", "the"), ("of", "and"), ("none",), ("w5", "none", "W6")):
        found = index.ranked(by, terms, 20)
        assert order(found.scores, 20) == order(S.bm25_by_index(by, terms), 20) == order(S.bm25(docs, terms, content="content"), 20), terms
        fewer += found.needed.count() < found.bounds.count()
        hits = docs.where("doc_id % 3 = 0")
        assert order(index.ranked(by, terms, 5, hits).scores, 5) == order(S.bm25_by_index(by, terms).join(hits, "doc_id", "left_semi"), 5)
    few = index.ranked(by, ("w1",), 20)
    assert fewer >= 4 and few.needed.count() < few.bounds.count() / 2


def test_a_segment_that_is_added_twice_counts_once(spark, tree, tmp_path, monkeypatch):
    where = [str(tree / "collections"), str(tmp_path / "t"), str(tmp_path / "s")]
    save = ingest.save_state
    monkeypatch.setattr(ingest, "save_state", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ingest.ingest(spark, *where, "2024-01-01", index=str(tmp_path / "i"))
    monkeypatch.setattr(ingest, "save_state", save)
    ingest.ingest(spark, *where, "2024-01-02", index=str(tmp_path / "i"))
    assert index.read(spark, str(tmp_path / "i")).stats.count() == 3


def test_a_range_of_terms_reaches_the_scan(spark, tmp_path):
    docs = spark.createDataFrame([("a", "water waters later"), ("b", "watch the letter"), ("c", None)], "doc_key string, content string")
    index.rebuild(docs, str(tmp_path / "i"))
    by = index.read(spark, str(tmp_path / "i"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(index.pattern_lookup(by, "wat*")).count("GreaterThanOrEqual(term,wat)") == 2
    assert "GreaterThanOrEqual(reversed,ret)" in plan(index.terms_like(by, "*ter"))
    for typed, want in (("wat*", "ab"), ("*ter", "ab"), ("w?ter", "a"), ("WATER", "a"), ("*at*", "ab"), ("*", "ab"), ("w.ter", ""), ("???", "b"), ("lat?r", "a")):
        assert "".join(sorted(r["doc_key"] for r in index.pattern_lookup(by, typed).collect())) == want, typed
        assert "".join(sorted(r["doc_key"] for r in docs.where(S.has_wildcard("content", typed)).collect())) == want, typed


def test_a_run_that_fails_between_its_writes_is_repeated(spark, tree, tmp_path, monkeypatch):
    where = [str(tree / "collections"), str(tmp_path / "t"), str(tmp_path / "s")]
    save = ingest.save_state
    monkeypatch.setattr(ingest, "save_state", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ingest.ingest(spark, *where, "2024-01-01")
    monkeypatch.setattr(ingest, "save_state", save)
    assert ingest.ingest(spark, *where, "2024-01-02")["processed"] == 3
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_summary_and_catalog(spark, tmp_path):
    from rostrum.operators import corpus

    summary = corpus.batch_summary(spark.createDataFrame([("a", 3, 0), ("b", 2, 4)], "name string, speakers long, questions long"))
    files.write_summary(summary, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r/markdown").glob("*.txt"))
    assert text.startswith("# Processing summary\n\n- Files: 2\n- Speakers: 5\n- Questions: 4\n")
    assert spark.read.json(str(tmp_path / "r/json")).first()["files"] == 2
    best = corpus.best_worst(spark.createDataFrame([("b.html", 3), ("a.html", 3), ("c.html", 1)], "name string, n long"), "n", "name").first()
    assert (best["best"], best["most"], best["worst"], best["least"]) == ("a.html", 3, "c.html", 1)
    spark.range(1).createOrReplaceTempView("some_table")
    assert files.table_exists(spark, "some_table") and not files.table_exists(spark, "no_table")


def test_searches_as_users_type_them(spark, tmp_path):
    docs = spark.createDataFrame([(1, "That water, c(3)."), (2, "water that axb"), (3, None), (4, "")], "doc_id long, content string")
    docs = docs.selectExpr("*", "'t' title", "date'2024-01-01' sitting_date", "'s' source", "'p' speaker", "null speaker2", "'d' document_type", "1 ord")
    index.rebuild(docs, str(tmp_path / "i"), "doc_id")
    stored = index.read(spark, str(tmp_path / "i"), "doc_id")
    for request, want in ((S.SearchRequest(terms=("That", "that")), {1, 2}), (S.SearchRequest(terms=("c(", "water")), {1}), (S.SearchRequest(phrase="That Water"), {1}), (S.SearchRequest(prefix="WAT"), {1, 2}), (S.SearchRequest(terms=("a.b",)), set()), (S.SearchRequest(terms=("nothing",), sort="relevance"), set())):
        for by in (None, stored):
            found = S.search(docs, request, by)
            assert {r["doc_id"] for r in found.page.collect()} == want and found.total.first()["n"] == len(want), request
    best = S.search(docs, S.SearchRequest(terms=("c", "water"), mode="or", sort="relevance"), stored).page.collect()
    assert [r["doc_id"] for r in best] == [1, 2] and "<em>c</em>(3)" in best[0]["highlight"]
    assert S.bm25_by_index(stored, ("water",)).count() == S.bm25(docs, ("water",), content="content").count() == 2


def test_stream_equals_batch(spark, tree, tmp_path):
    def poll(when):
        watch(spark, str(tree / "collections"), str(tmp_path / "t"), str(tmp_path / "s"), str(tmp_path / "c"), when).awaitTermination()
        return spark.read.parquet(str(tmp_path / "t")).count()

    assert poll("2024-01-01") == 3
    assert poll("2024-01-02") == 3
    (tree / "collections/South/2023/March/5/part9.html").write_text(PAGE.format("LATE"))
    (tree / "collections/South/2023/March/5/part9_metadata.txt").write_text("Part 9 Speakers:\nSpeaker 1: HON. Z\n")
    assert poll("2024-01-03") == 4


def test_metadata_that_comes_a_poll_later(spark, tree, tmp_path):
    folder, where = tree / "collections", [str(tree / "collections"), str(tmp_path / "t"), str(tmp_path / "s")]
    told = []

    def poll(day):
        watch(spark, *where, str(tmp_path / "c"), f"2024-01-0{day}", report=told.append, missed=str(tmp_path / "m"), late="1 hour", index=str(tmp_path / "i")).awaitTermination()
        return {r["path"].rpartition("/")[2] for r in spark.read.parquet(where[1]).collect()}

    def put(name, text, at):
        (folder / "South/2023/March/5" / name).write_text(text)
        os.utime(folder / "South/2023/March/5" / name, (at, at))

    now = time.time()
    put("part8.html", PAGE.format("EARLY"), now)
    assert "part8.html" not in poll(1)
    put("part8_metadata.txt", "Part 8 Speakers:\nSpeaker 1: HON. E\n", now + 60)
    assert "part8.html" in poll(2) and told[-1]["processed"] == 1
    for k in (1, 2):  # time goes on in both streams, and the page that has no metadata is missed
        put(f"later{k}.html", PAGE.format("LATER"), now + k * 90_000)
        put(f"later{k}_metadata.txt", "Part 9 Speakers:\nSpeaker 1: HON. F\n", now + k * 90_000)
        assert f"later{k}.html" in poll(2 + k)
    assert [r["path"].rpartition("/")[2] for r in spark.read.parquet(str(tmp_path / "m")).collect()] == ["part1.html"]
    (folder / "North Isles/2025/Feb/24/part1_metadata.txt").write_text("Part 1 Speakers:\nSpeaker 1: HON. L\n")
    assert retried(spark, *where, "2024-01-09", str(tmp_path / "m"))["processed"] == 1
    assert len(poll(9)) == 6


def test_registry(spark, tmp_path):
    assert files.registry(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("{broken")
    assert files.registry(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "r.json").write_text(json.dumps({"k": {"url": "u", "filename": "f"}}, indent=1))
    row = files.registry(spark, str(tmp_path / "r.json")).first()
    assert (row["key"], row["url"], row["filename"], row["date"]) == ("k", "u", "f", None)


def test_reports(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/processing_report.json").write_text(json.dumps({"directory": "a", "total_parts": 3, "questions_extracted": 1, "date": None, "parliament": "18"}))
    row = files.reports(spark, str(tmp_path)).first()
    assert (row["total_parts"], row["date"], row["parliament"], row["session"]) == (3, "Unknown", "18", "Unknown")


def test_damaged_files_go_to_quarantine(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<p>\xff\xfe</p>")
    (tmp_path / "b.html").write_text("<p>fine</p>")
    good, bad = files.quarantined(files.pages(spark, str(tmp_path)), ~files.is_damaged("text"))
    assert (good.count(), bad.count()) == (1, 1)


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([('say "x"', None)], "a string, b string")
    files.write_csv(df.coalesce(1), str(tmp_path / "c"))
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv"))
    assert text == '"a","b"\n"say ""x""",""\n' or text == '"a","b"\n"say ""x""",\n'


def test_positions_need_no_shuffle_and_several_rows_of_a_key_are_one_document(spark, tmp_path):
    long = " ".join(f"w{k % 7}" for k in range(3000))
    rows = [(1, "b a B c"), (2, None), (3, ""), (4, "a"), (5, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = index.positional(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["term"], r["doc_id"]): (r["tf"], r["positions"]) for r in found.collect()}
    words = {k: (t or "").lower().split() for k, t in rows}
    want = {(w, k): (ws.count(w), [i for i, x in enumerate(ws) if x == w]) for k, ws in words.items() for w in ws}
    assert got == want
    twice = docs.unionByName(docs.where("doc_id = 1").withColumn("text", F.lit("z a")))
    got = {(r["term"], r["doc_id"]): (r["tf"], r["positions"]) for r in index.positional(twice).collect()}
    assert got == want | {("a", 1): (2, [1, 1]), ("z", 1): (1, [0])}
    for name, df in (("one", docs), ("several", twice)):
        index.rebuild(df, str(tmp_path / name), "doc_id", "text")
        by = index.read(spark, str(tmp_path / name), "doc_id")
        assert by.postings.count() == len(want) + (1 if name == "several" else 0) and by.stats.count() == df.count() and not any((tmp_path / name).glob("*/unsorted"))


def test_a_common_term_is_several_ranges(spark, tmp_path):
    """Else one task sorts and writes all of its postings."""
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    index.rebuild(spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("the the").alias("text")), str(tmp_path / "i"), "doc_id", "text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    sizes = [r["n"] for r in spark.read.parquet(*map(str, (tmp_path / "i").glob("*/postings"))).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 2000 and max(sizes) < 1000


def test_patterns_together_equal_each_alone(spark):
    docs = spark.createDataFrame([(k, f"water w{k} later {'minister' if k % 2 else 'alter'}") for k in range(20)] + [(50, None)], "doc_id long, text string")
    alone, typed = index.index_of(docs), ("wat*", "*ter", "W1?", "no*such", "*")
    want = {(p, r["doc_id"]) for p in typed for r in index.pattern_lookup(alone, p).collect()}
    together = index.patterns_lookup(index.index_of(docs, positions=False), typed)
    rows = [tuple(r) for r in together.select("pattern", "doc_id").collect()]
    assert set(rows) == want and len(rows) == len(want)


def shuffle_bytes(spark):
    """(stage, bytes that it wrote for shuffles) of the stages that the session knows of."""
    none = spark._jvm.java.util.ArrayList()
    quantiles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    found = spark._jsc.sc().statusStore().stageList(none, False, False, quantiles, none)
    return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}


@pytest.mark.parametrize("bits", [1, 6])
def test_an_index_is_written_and_merged_without_shuffling_postings(spark, tmp_path, monkeypatch, bits):
    """With 2 documents a block, blocks stay full and keep their numbers in a merge; with 64 they are numbered anew."""
    monkeypatch.setattr(index, "BLOCK_BITS", bits)
    rng = random.Random(8)
    texts = [" ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.choice([3, 300, 3000]))) for _ in range(600)] + [None, "", " .", "the the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    changed = docs.where("doc_id % 2 = 1 or doc_id % 10 = 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("new "), "text")).otherwise(F.col("text")))
    at, before = str(tmp_path / "i"), max(shuffle_bytes(spark), default=-1)
    index.rebuild(docs.where("doc_id % 2 = 0"), at, "doc_id", "text")
    index.add_segment(changed, docs.where("doc_id % 10 = 0").select("doc_id"), at, "doc_id", "text")
    assert index.merge(spark, at, "doc_id") == 2
    postings = sum(p.stat().st_size for p in (tmp_path / "i").rglob("postings/*.parquet"))
    assert sum(n for stage, n in shuffle_bytes(spark).items() if stage > before) < postings / 4
    index.rebuild(changed.unionByName(docs.where("doc_id % 2 = 0 and doc_id % 10 <> 0")), str(tmp_path / "whole"), "doc_id", "text")
    merged, whole = index.read(spark, at, "doc_id"), index.read(spark, str(tmp_path / "whole"), "doc_id")
    rows = lambda df: sorted((r["term"], r["doc_id"], r["tf"], tuple(r["positions"])) for r in df.postings.collect())
    assert rows(merged) == rows(whole)
    assert sorted(map(str, merged.stats.collect())) == sorted(map(str, whole.stats.collect()))
    assert sorted(map(tuple, merged.terms.collect())) == sorted(map(tuple, whole.terms.collect()))
    best = lambda df: [tuple(r) for r in df.orderBy(F.desc("score"), "doc_id").limit(10).collect()]
    for terms in (("w7",), ("the", "w39"), ("new", "w1")):
        assert best(index.ranked(merged, terms, 10).scores) == best(index.ranked(whole, terms, 10).scores) == best(S.bm25_by_index(merged, terms))
