"""Stored words are compressed, pages are made once, and what is scanned over paragraphs holds no text."""

from __future__ import annotations

from figtrail.functions import ordered
from figtrail.operators import sections, usage
from figtrail.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def test_the_scan_over_paragraphs_stores_no_second_text(spark, monkeypatch):
    stored, whole = [], ordered.cut
    monkeypatch.setattr(ordered, "cut", lambda df: stored.append(df) or whole(df))
    blocks = spark.createDataFrame([("r", 1, 1, 1, "paragraph", "Sales grew in", 0.0, 10.0), ("r", 1, 2, 2, "paragraph", "every region.", 0.0, 10.0), ("r", 1, 3, 2, "paragraph", "Costs fell.", 20.0, 30.0)],
                                   "report_id string, section_id int, ord int, page int, kind string, text string, y0 double, y1 double")
    assert sorted(r.text for r in sections.join_paragraphs(blocks).collect()) == ["Costs fell.", "Sales grew in every region."]
    for df in stored:
        assert "text" not in [f.name for c in df.schema.fields if c.dataType.typeName() == "struct" for f in c.dataType.fields]


def test_pages_of_the_layout_queue_are_made_once(spark, monkeypatch):
    made, whole = [], usage.layout_queue
    monkeypatch.setattr(usage, "layout_queue", lambda pages, *rest: made.append(pages) or whole(pages, *rest))
    assert catalog.load()[0]["u11_layout_queue"](spark, FOLDER).count() > 0
    assert "Aggregate" not in made[0]._jdf.queryExecution().optimizedPlan().toString()


def test_stored_words_are_compressed(spark, monkeypatch):
    from figtrail.sources import readers

    paths, whole = [], readers.read_words
    monkeypatch.setattr(readers, "read_words", lambda s, path: paths.append(path) or whole(s, path))
    catalog.load()[0]["s1_read_words"](spark, FOLDER)
    assert all(f.endswith(".json.gz") for f in spark.read.format("binaryFile").load(paths[0]).select("path").toPandas()["path"])
