import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import names
from quillgraph.sinks import page_files
from quillgraph.sources import documents

PAGES = ["House music", "House music#Deep house", "A/B x", "C:D?", "50% \"é\" *日*", "Drum+bass", "a\\b|c"]


def _bodies(spark, pages, more="name"):
    return spark.createDataFrame([(p, json.dumps({more: p, "genres": [i]})) for i, p in enumerate(pages)], "page string, body string").repartition(4)


def test_a_file_for_each_page_and_back(spark, tmp_path):
    path = str(tmp_path / "docs")
    page_files.write_pages(_bodies(spark, PAGES), path)
    assert len(os.listdir(path)) == len(PAGES) and all(f.endswith(".json") for f in os.listdir(path))
    back = documents.read_entity_docs(spark, path, documents.ARTIST_DOC).collect()
    safe = spark.createDataFrame([(p,) for p in PAGES], "p string").select(names.unsanitize(names.sanitize("p")).alias("p")).collect()
    assert sorted(r.page for r in back) == sorted(r.p for r in safe)
    assert sorted(r.name for r in back) == sorted(PAGES)
    # Another run takes the place of the first one; append adds to it.
    page_files.write_pages(_bodies(spark, PAGES[:2]), f"file://{path}")
    assert len(os.listdir(path)) == 2
    page_files.write_pages(_bodies(spark, PAGES[1:4]), path, mode="append")
    assert len(os.listdir(path)) == 4
    page_files.write_pages(_bodies(spark, PAGES).limit(0), path)
    assert os.listdir(path) == []


@pytest.mark.parametrize("bad", [("A", "{}"), (None, "{}"), ("Z", None)])
def test_a_failed_task_leaves_no_file(spark, tmp_path, bad):
    path = str(tmp_path / "docs")
    page_files.write_pages(_bodies(spark, ["Old"]), path)
    rows = spark.createDataFrame([(f"P{i}", "{}") for i in range(40)] + [("A", "{}"), bad], "page string, body string")
    with pytest.raises(Exception):
        page_files.write_pages(rows, path)
    assert os.listdir(path) == ["Old.json"]


def test_genres_and_artists(spark, tmp_path):
    when = F.lit("2025-01-02 03:04:05").cast("timestamp").alias("last_revision_date")
    genres = spark.createDataFrame([("Jazz", "d", ["x"]), ("A/B", None, [])], "page string, description string, top_artists array<string>")
    mixes = F.lit(None).cast("struct<kind:string,help_reason:string,items:array<struct<kind:string,id:string,note:string>>>").alias("mixes")
    page_files.write_genre_pages(genres.select("*", when, mixes), str(tmp_path / "g"))
    assert json.loads((tmp_path / "g" / "Jazz.json").read_text()) == {"description": "d", "last_revision_date": "2025-01-02T03:04:05Z", "top_artists": ["x"]}
    rows = {r.page: r for r in documents.read_entity_docs(spark, str(tmp_path / "g"), documents.GENRE_DOC).collect()}
    assert rows["A/B"].top_artists == [] and rows["A/B"].last_revision_date == datetime(2025, 1, 2, 3, 4, 5)
    artists = spark.createDataFrame([("Sun Ra", "Sun Ra", None, [3])], "page string, name string, description string, genres array<long>")
    page_files.write_artist_pages(artists.select("*", when), str(tmp_path / "a"))
    assert json.loads((tmp_path / "a" / "Sun Ra.json").read_text()) == {"name": "Sun Ra", "last_revision_date": "2025-01-02T03:04:05Z", "description": None, "genres": [3]}
