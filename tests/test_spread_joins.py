"""Tables that grow with the pages are shuffled, not sent whole through the driver."""

from figtrail.operators import layout, metadata, tables

WORDS = "report_id int, page int, word_no int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, conf double"


def _stored(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).write.parquet(str(folder))
    return spark.read.parquet(str(folder))


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_tables_of_pages_are_not_broadcast(spark, tmp_path):
    rows = [(1, p, r * 3 + k, t, 50.0 + 100 * k, 14.0 * r, 50.0 + 100 * k + 6 * len(t), 14.0 * r + 10, 10.0, False, 0.9)
            for p in range(5) for r in range(4) for k, t in enumerate(("Line", str(100 + r), str(7 + r)))]
    segments = layout.segments_of(_stored(spark, rows, WORDS, tmp_path / "words"))
    segments.write.parquet(str(tmp_path / "segments"))
    segments = spark.read.parquet(str(tmp_path / "segments"))
    tables.table_regions(segments).write.parquet(str(tmp_path / "regions"))
    regions = spark.read.parquet(str(tmp_path / "regions"))
    anchors = tables.column_anchors(segments, regions)
    assigned = tables.assign_columns(segments, regions, anchors)
    for df in (anchors, assigned, tables.table_problems(assigned, anchors), layout.kpi_pairs(segments)):
        assert "BroadcastHashJoin" not in _plan(df)
    assert tables.table_problems(assigned, anchors).count() == 5


def test_the_words_of_a_report_are_not_broadcast(spark, tmp_path):
    text = "Nova Steel Limited announced results. " + "Other words of the page follow. " * 40
    pages = _stored(spark, [(1, p, text) for p in range(50)], "report_id int, page int, text string", tmp_path / "pages")
    names = metadata.legal_names(pages)
    assert "BroadcastHashJoin [report_id" not in "".join(x for x in _plan(names).splitlines() if "BuildLeft" in x)
    uses = metadata.phrase_pages(metadata.page_tokens(pages), _stored(spark, [(1, "Nova Steel")], "report_id int, phrase string", tmp_path / "phrases"))
    assert [l for l in _plan(uses).splitlines() if "BroadcastHashJoin" in l and "page" in l] == []
    assert [(r.head, r.suffix, r.pages) for r in names.collect()] == [("Nova Steel", "Limited", 50)]
