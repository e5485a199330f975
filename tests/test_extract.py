from datetime import datetime

from pyspark.sql import functions as F

from quillgraph.functions.wikitext import page_boxes
from quillgraph.operators import extract

GENRE = "infobox music genre"


def test_two_boxes_under_headings():
    page = (
        "Intro\n{{Infobox music genre\n| name = A\n| subgenres = * [[B]]\n}}\n'''A''' is it.\n\n"
        "== Second ==\nwords\n=== Third ''x'' ===\n{{infobox music genre|name=C|other}}\n\nC lead.\n== End ==\nnot this"
    )
    first, second = page_boxes(page, GENRE)
    assert first["heading"] is None and first["params"] == {"name": "A", "subgenres": "* [[B]]"}
    assert first["description"] == "'''A''' is it."
    assert second["heading"] == "Third x" and second["params"] == {"name": "C"}
    assert second["description"] == "C lead."


def test_lead_continues_into_first_section_when_blank():
    page = "{{Infobox music genre|name=A}}\n== History ==\nText here.\n== Next ==\nmore"
    assert page_boxes(page, GENRE)[0]["description"] == "Text here."


def test_lead_skips_refs_images_and_leading_templates():
    page = (
        "{{Infobox music genre|name=A}}\n{{Use dmy dates}}\n{{short description|x}}\n[[File:a.jpg|thumb|see [[B]]]]\n"
        "{{Nihongo|'''A'''|b}} is<ref name=x>{{cite|a=b}} c</ref> a {{tl|kept}} [[genre]]<ref name=x />."
        "{{Use mdy dates}}\n* item<ref>kept</ref> {{in list}}\n"
    )
    assert page_boxes(page, GENRE)[0]["description"] == (
        "{{Nihongo|'''A'''|b}} is a {{tl|kept}} [[genre]].\n* item<ref>kept</ref> {{in list}}"
    )


def test_box_in_module_inherits_parameters():
    page = "{{Infobox song|name=Outer|year=1|module={{Infobox music genre|name=Inner|subgenres=[[X]]}}}}\nLead."
    box = page_boxes(page, GENRE)[0]
    assert box["params"]["name"] == "Inner" and box["params"]["year"] == "1" and box["params"]["subgenres"] == "[[X]]"
    assert box["description"] == "Lead."


def test_nested_pipes_and_equals_stay_in_value():
    page = "{{Infobox music genre|name={{a|b=c|d}} x|link=[[P|q=r]]|n=<nowiki>|z=1</nowiki>}}"
    assert page_boxes(page, GENRE)[0]["params"] == {
        "name": "{{a|b=c|d}} x", "link": "[[P|q=r]]", "n": "<nowiki>|z=1</nowiki>",
    }


def test_same_heading_last_box_wins_and_tables_are_opaque():
    page = (
        "{{Infobox music genre|name=A}}one\n{{Infobox music genre|name=B}}two\n"
        "{|\n| {{Infobox music genre|name=T}}\n|}\ntail"
    )
    boxes = page_boxes(page, GENRE)
    assert [b["params"]["name"] for b in boxes] == ["B"]
    assert boxes[0]["description"].startswith("two") and boxes[0]["description"].endswith("tail")


def test_unclosed_markup_is_text():
    assert page_boxes("{{Infobox music genre|name=A", GENRE) == []
    assert page_boxes("{{Infobox music genre|name=A}}x [[open {{open", GENRE)[0]["description"] == "x [[open {{open"
    assert page_boxes("{{Infobox music genre|name=A}}x<ref>never closed", GENRE)[0]["description"] == "x"


def _pages(spark, rows):
    at = datetime(2025, 4, 1)
    return spark.createDataFrame(
        [(i, title, at, body) for i, (title, body) in enumerate(rows)], "page_id long, title string, ts timestamp, text string"
    )


def test_classify_and_redirects(spark):
    pages = _pages(
        spark,
        [
            ("R", "#REDIRECT [[Jazz#Cool]]"), ("r2", "#redirect [[Jazz]]"), ("WP:x", "#REDIRECT [[Jazz]]"),
            ("G", "{{Infobox music genre}} {{Infobox musical artist}}"), ("A", "{{Infobox musical artist}}"),
            ("User:G", "{{infobox music genre}}"), ("N", "plain"), ("Bad", "#REDIRECT nowhere"),
        ],
    )
    kinds = {r.title: r.kind for r in extract.drop_namespaced(extract.classify_pages(pages)).collect()}
    assert kinds == {"R": "redirect", "WP:x": "redirect", "G": "genre", "A": "artist", "Bad": "redirect"}
    assert extract.classify_pages(pages, any_case_redirect=True).filter("title = 'r2'").count() == 1
    parsed = {r.title: (r.target, r.error) for r in extract.read_redirects(extract.classify_pages(pages), "w").collect()}
    assert parsed == {"R": ("Jazz#Cool", None), "WP:x": ("Jazz", None), "Bad": (None, "invalid")}


def test_process_genres_renames_and_ignores(spark):
    pages = _pages(
        spark,
        [
            ("Brega pop", "{{Infobox music genre|name=Calypso|stylistic_origins=[[X]], [[Y|y]]|fusiongenres={{hlist|[[Z]]}}}}Lead<!-- c -->."),
            ("Late", "{{Infobox music genre}}"),
            ("Skip", "== S ==\n{{Infobox music genre|name=s}}\n== T ==\n{{Infobox music genre|name=t}}"),
        ],
    )
    genres = extract.process_genres(pages)
    renames = spark.createDataFrame(
        [("Brega pop", "Brega-pop", None), ("Late", "New", datetime(2025, 4, 1, 0, 1))],
        "page string, new_label string, fixed_at timestamp",
    )
    ignored = spark.createDataFrame([("Skip", "S"), ("Late", "x")], "name string, heading string")
    rows = {r.page: r for r in extract.drop_ignored(extract.apply_renames(genres, renames), ignored).collect()}
    assert set(rows) == {"Brega pop", "Late", "Skip#T"}
    brega = rows["Brega pop"]
    assert brega.label == "Brega-pop" and brega.description == "Lead."
    assert (brega.stylistic_origins, brega.fusion_genres, brega.subgenres) == (["X", "Y"], ["Z"], [])
    assert rows["Late"].label == "Late"  # edited within the minute of leeway: not before it
    assert rows["Skip#T"].label == "t"
    later = renames.withColumn("fixed_at", F.expr("fixed_at + interval 1 second"))
    again = {r.page: r.label for r in extract.apply_renames(genres, later).collect()}
    assert again["Late"] == "New"
    ignored_root = spark.createDataFrame([("Late", None)], "name string, heading string")
    assert "Late" not in {r.page for r in extract.drop_ignored(genres, ignored_root).collect()}
    assert {r.page: r.relations for r in extract.relation_count(genres).collect()}["Brega pop"] == 3
    assert extract.duplicate_pages(genres.union(genres)).count() == 4
    leads = {r.page: r.description for r in extract.extract_lead(pages, "genre").collect()}
    assert leads["Brega pop"] == "Lead." and leads["Skip#S"] == ""
