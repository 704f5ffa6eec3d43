import zipfile

from pyspark.sql import functions as F

from heddle.functions.vectors import cosine, nearest
from heddle.operators import memory, retrieval, service
from heddle.sources import files
from heddle.streaming import metrics, tiers


def test_cosine_of_unlike_vectors(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0], [1.0, 2.0]), ([], []), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in rows.select(cosine("a", "b")).collect()] == [1, 0, -1, 0, 0, 0]


def test_nearest_of_an_empty_table(spark):
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(v, v, 3).count() == 0


def test_sliding_windows_keep_the_ragged_tail(spark):
    rows = spark.createDataFrame([(1, i) for i in range(7)], "k long, i long")
    got = sorted((r["window"], r["first"], r["last"]) for r in memory.sliding_windows(rows, "k", "i").collect())
    assert got == [(0, 0, 4), (1, 3, 6), (2, 6, 6)]


def test_short_segments_join_the_one_before(spark):
    marked = spark.createDataFrame([(1, i, i in (1, 3, 4)) for i in range(6)], "k long, i long, boundary boolean")
    got = sorted((r["segment"], r["first"], r["last"], r["n"]) for r in memory.segments(marked, "k", "i").collect())
    assert got == [(0, 0, 0, 1), (1, 1, 3, 3), (2, 4, 5, 2)]


def test_budget_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([(1, 0.9, "x" * 40), (2, 0.8, "x" * 400), (3, 0.7, "x" * 4)], "id long, score double, text string")
    assert [r["id"] for r in retrieval.within_budget(rows, 50).collect()] == [1]


def test_best_of_keeps_the_earlier_channel_on_ties(spark):
    a = spark.createDataFrame([(1, 0.5, "a")], "id long, score double, source string")
    b = spark.createDataFrame([(1, 0.5, "b"), (2, 0.1, "b")], "id long, score double, source string")
    assert sorted(map(tuple, retrieval.best_of([a, b]).collect())) == [(1, 0.5, "a"), (2, 0.1, "b")]


def test_nearest_rank_percentiles(spark):
    rows = spark.createDataFrame([("e", float(i)) for i in range(1, 101)] + [("e", None)], "event_type string, value double")
    assert tuple(service.percentiles(rows).first()) == ("e", 50.0, 95.0, 99.0)


def streamed(spark, path, schema, make):
    out = make(spark.readStream.schema(schema).parquet(path))
    q = out.writeStream.format("memory").queryName("out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("out")


def test_buffer_flushes_by_tokens(spark, tmp_path):
    rows = spark.createDataFrame([("a", 300), ("a", 300), ("a", 10), ("b", 600)], "key string, tokens long").coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    got = streamed(spark, str(tmp_path / "in"), rows.schema, metrics.buffered)
    assert sorted(map(tuple, got.collect())) == [("a", 2, 600), ("b", 1, 600)]


def test_stream_roll_up_agrees_with_batch(spark, tmp_path):
    rows = spark.range(0, 300).select((F.timestamp_seconds(F.col("id") * 60)).alias("ts"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value"))
    rows.write.parquet(str(tmp_path / "ev"))
    got = {r["start"]: r["n"] for r in streamed(spark, str(tmp_path / "ev"), rows.schema, metrics.roll_up).collect()}
    batch = {r["start"]: r["n"] for r in metrics.roll_up(rows).collect()}
    assert got and all(batch[k] == n for k, n in got.items())


def test_short_term_memory_promotes_its_first_segments(spark, tmp_path):
    rows = spark.createDataFrame([("a", n) for n in (500, 600, 500, 500, 100, 2100)] + [("b", 10)], "key string, tokens long").coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    got = streamed(spark, str(tmp_path / "in"), rows.schema, lambda s: tiers.short_term(s, batch=3))
    assert sorted((r["segments"], r["tokens"]) for r in got.collect()) == [(3, 1600), (3, 2700)]


def test_tiers_flush_and_promote(spark, tmp_path):
    rows = spark.createDataFrame([("a", i) for i in range(12)], "key string, id long").coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    got = streamed(spark, str(tmp_path / "in"), rows.schema, lambda s: tiers.tiers(s, sensory=3, short=7, share=0.3, long=2))
    assert sorted(map(tuple, got.collect())) == [("a", "long", 3, 2), ("a", "long", 3, 2), ("a", "short", 3, 3), ("a", "short", 3, 6), ("a", "short", 3, 9), ("a", "short", 3, 9)]


def test_consolidation_by_number_or_time(spark, tmp_path):
    at = [0.0, 1.0, 2.0, 3.0, 70.0, 71.0]
    rows = spark.createDataFrame([("a", t) for t in at], "key string, seconds double").coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    got = streamed(spark, str(tmp_path / "in"), rows.schema, lambda s: tiers.triggered(s, most=3))
    assert sorted((r["events"], r["at"]) for r in got.collect()) == [(2, 70.0), (3, 2.0)]


def test_text_and_docx_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\nbody\n")
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in (("Heading1", "Top"), ("Normal", "some &amp; text"), ("Heading2", "Sub"), ("Normal", "more")))
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    (tmp_path / "c.docx").write_bytes(b"no archive")
    assert [(r["kind"], r["text"]) for r in files.texts(spark, str(tmp_path / "*.md")).collect()] == [("md", "# T\n\nbody\n")]
    got = {r["place"]: (r["style"], list(r["headings"]), r["text"]) for r in files.docx(spark, str(tmp_path / "b.docx")).collect()}
    assert got == {0: ("Heading1", ["Top"], "Top"), 1: ("Normal", ["Top"], "some & text"), 2: ("Heading2", ["Top", "Sub"], "Sub"), 3: ("Normal", ["Top", "Sub"], "more")}
    assert files.docx(spark, str(tmp_path / "c.docx")).count() == 0
