from datetime import date

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import names, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "page, name, heading",
    [("Jazz", "Jazz", None), ("UK hard house#Scouse house", "UK hard house", "Scouse house"), ("A#b#c", "A", "b#c"), ("A#", "A", "")],
)
def test_page_parts(spark, page, name, heading):
    got = one(spark, names.page_parse("p"), p=page)
    assert (got["name"], got["heading"]) == (name, heading)
    assert one(spark, names.page_format(names.page_name("p"), names.page_heading("p")), p=page) == page
    assert one(spark, names.root_page("p"), p=page) == name
    assert one(spark, names.with_heading("p", F.lit("x")), p=page) == name + "#x"


def test_file_names_round_trip(spark):
    page = 'A/B\\C:D*E?F"G<H>I|J#K'
    safe = one(spark, names.sanitize("p"), p=page)
    assert not set(safe) & set(names.FILE_UNSAFE)
    assert one(spark, names.unsanitize(names.sanitize("p")), p=page) == page


def test_page_order_puts_no_heading_first(spark):
    pages = ["A b", "A#x", "A", "B", "A!"]
    df = spark.createDataFrame([(p,) for p in pages], "page string")
    assert [r.page for r in df.orderBy(*names.page_order("page")).collect()] == ["A", "A#x", "A b", "A!", "B"]


def test_urls(spark):
    assert one(spark, names.page_url("d", "p"), d="en.wikipedia.org", p="New wave#In the UK") == (
        "https://en.wikipedia.org/wiki/New_wave#In the UK"
    )
    assert one(spark, names.dump_url(F.lit("enwiki"), "d"), d="2025-01-23") == "https://dumps.wikimedia.org/enwiki/20250123/"


@pytest.mark.parametrize(
    "url, host",
    [
        ("https://en.wikipedia.org/wiki/Main_Page", "en.wikipedia.org"),
        ("http://en.wikipedia.org/something", "en.wikipedia.org"),
        ("not a url", None), ("https://bad", None), ("", None),
    ],
)
def test_host(spark, url, host):
    assert one(spark, names.url_host("u"), u=url) == host


@pytest.mark.parametrize(
    "name, day",
    [
        ("enwiki-20250123-pages-articles-multistream", date(2025, 1, 23)),
        ("invalid", None), ("enwiki-2025012-x", None), ("enwiki-20251399-x", None),
    ],
)
def test_dump_date(spark, name, day):
    assert one(spark, names.dump_date("n"), n=name) == day


@pytest.mark.parametrize(
    "raw, norm",
    [("Hip-Hop", "hip-hop"), ("Pixadão", "pixadao"), ("Yé-yé", "ye-ye"), ("演歌", "演歌"), ("ΣΑΣ", "σασ")],
)
def test_normalize(spark, raw, norm):
    assert one(spark, names.normalize_text("t"), t=raw) == norm


@pytest.mark.parametrize(
    "raw, kept",
    [("A (B) (C)", "A (B)"), ("(What) genre", "(What) genre"), ("No qualifier", "No qualifier"), (" (x)", " (x)"), ("A (b) c", "A (b) c")],
)
def test_strip_qualifier(spark, raw, kept):
    assert one(spark, names.strip_qualifier("t"), t=raw) == kept


def test_edge_types(spark):
    codes = spark.createDataFrame([("Derivative",), ("Subgenre",), ("FusionGenre",)], "n string")
    both = codes.select("n", names.edge_type_code("n").alias("c")).withColumn("back", names.edge_type_name("c"))
    assert [(r.n, r.c) for r in both.collect()] == [("Derivative", 0), ("Subgenre", 1), ("FusionGenre", 2)]
    assert all(r.n == r.back for r in both.collect())
    with pytest.raises(Exception, match="unknown edge type"):
        spark.createDataFrame([("Other",)], "n string").select(names.edge_type_code("n")).collect()


@pytest.mark.parametrize(
    "body, name, heading, error",
    [
        ("#REDIRECT [[United Kingdom]]", "United Kingdom", None, None),
        ("#REDIRECT [[UK hard house#Scouse house]]", "UK hard house", "Scouse house", None),
        ("#REDIRECT [[UK hard house#Scouse house]]\n{{Redirect category shell|\n{{R to section}}\n}}\n\n[[Category:House]]", "UK hard house", "Scouse house", None),
        ("#REDIRECT [[A|b]]", "A|b", None, None),
        ("Not a redirect", None, None, "invalid"),
        ("#REDIRECT [[open", None, None, "invalid"),
        ("#REDIRECT [http://en.wikipedia.org/w/index.php?title=Wikipedia:X/right_side&action=edit right panel]", "Wikipedia:X/right_side", None, None),
        ("#REDIRECT [http://example.com some text]", None, None, "external"),
        ("#REDIRECT [http://example.com/a?title=b&c some text]", None, None, "external"),
        ("#REDIRECT [http://nospace]", None, None, "invalid"),
    ],
)
def test_parse_redirect(spark, body, name, heading, error):
    got = one(spark, text.parse_redirect("t", F.lit("en.wikipedia.org")), t=body)
    assert tuple(got) == (name, heading, error)


def test_clean_and_links(spark):
    assert one(spark, text.clean_wikitext("t"), t="a<!-- x\ny -->b{{end}}") == "ab|}"
    body = (
        "* [[House music|house]]\n* [[Jazz]] {{hlist|[[Funk#History]]|[[Jazz]]}}"
        "[[File:a.png|thumb|see [[Hidden]]]] [[Category:Z]] <nowiki>[[No]]</nowiki><!-- [[No]] -->"
    )
    assert one(spark, text.extract_links("t"), t=body) == ["House music", "Jazz", "Funk#History", "Jazz"]


@pytest.mark.parametrize(
    "param, name",
    [
        ("'''Acid''' house<br>Second", "Acid house"), ("[[Jazz|Cool jazz]]<br />x", "Cool jazz"), ("[[Jazz]]", "Jazz"),
        ("", "Page"), (None, "Page"), ("Ska<ref>{{cite}}</ref>", "Ska"), ("{{lang|x}}", "Page"),
    ],
)
def test_entity_name(spark, param, name):
    assert one(spark, text.entity_name("n", "p"), n=param, p="Page") == name


def test_snippets(spark):
    body = "One two. Three" + "x" * 300 + "\nnext"
    assert one(spark, text.snippet("t", 9), t=body) == "One two."
    assert one(spark, text.snippet("t"), t="short\nrest") == "short"
    assert one(spark, text.first_sentence("t"), t=body) == "One two."
    assert one(spark, text.first_sentence("t"), t="no stop") == "no stop"
    assert one(spark, text.first_paragraph("t"), t="\nx") == ""


def test_parse_mixes(spark):
    def parsed(raw):
        got = one(spark, text.parse_mixes("t"), t=raw)
        return got["kind"], got["help_reason"], [tuple(i) for i in got["items"]]

    assert parsed("help: not ready") == ("help", "not ready", [])
    assert parsed(" help\n") == ("help", None, [])
    raw = (
        "https://www.youtube.com/playlist?list=PL1\n"
        "   https://www.youtube.com/playlist?list=PL2&x=1 # A great mix\n\n"
        "https://youtu.be/dQw4w9WgXcQ # on your own\nhttps://www.youtube.com/watch?v=abc&t=3\nnothing here"
    )
    assert parsed(raw) == (
        "mixes", None,
        [("playlist", "PL1", None), ("playlist", "PL2", "A great mix"), ("video", "dQw4w9WgXcQ", "on your own"), ("video", "abc", None)],
    )


@pytest.mark.parametrize(
    "label, body, left",
    [
        ("Hip house", "'''Hip house''', also known as '''rap house'''", "also known as '''rap house'''"),
        ("House-pop", 'House-pop (or "pop-house") is', '(or "pop-house") is'),
        ("Scouse house", "'''Donk''', also known as Bounce", "'''Donk''', also known as Bounce"),
        ("Christian Hip Hop", "'''Christian hip hop''' (gospel rap)", "(gospel rap)"),
        ("Bakersfield sound", "The '''Bakersfield sound''' is a", "is a"),
        ("Bakersfield sound", "The Bakersfield sound is a", "is a"),
        ("City pop", "{{Nihongo|'''City pop'''|x|lead=yes}} is a form", "is a form"),
        ("Folk rock", "{{Other uses|Folk-rock}} Folk rock is", "Folk rock is"),
        ("Anime song", "{{Nihongo|'''Anime song'''|also {{nihongo|'''''anison'''''}}}}  is a", "is a"),
        ("C++ (music)", "'''C++ (music)''' is", "is"),
    ],
)
def test_strip_name_prefix(spark, label, body, left):
    assert one(spark, text.strip_name_prefix("l", "t"), l=label, t=body) == left
