"""Wiki text as columns: redirects, links, names, snippets and mix files."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions.names import _col, page_heading, page_name, url_host

# Possessive runs: a greedy group would take a stack level per character.
LINK = r"\[\[([^\[\]|{}\n]++)(?:\|(?:[^\]]++|\](?!\]))*+)?+\]\]"
_IMAGE = r"(?is)\[\[\s*(?:file|image)\s*:(?:[^\[\]]++|\[\[[^\[\]]*+\]\]|\[[^\[\]]*+\])*+\]\]"
_CATEGORY = r"(?i)^\s*category\s*:"


def parse_redirect(text: Column | str, domain: Column | str) -> Column:
    """``struct(name, heading, error)`` of a redirect page.

    The first ``[[…]]`` counts; without one, the first ``[http…]`` address on
    this wiki.  ``error`` is null, ``invalid`` or ``external``.
    """
    text, domain = _col(text), _col(domain)
    found = F.struct(
        F.contains(text, F.lit("[[")).alias("wiki"),
        F.regexp_extract(text, r"(?s)\[\[.*?\]\]", 0).alias("link"),
        F.regexp_extract(text, r"(?s)\[(http[^\]]*?) [^\]]*\]", 1).alias("url"),
    )

    def read(f: Column) -> Column:
        # Bound once, so the patterns above are not repeated in every branch.
        page = F.substring(f["link"], 3, F.char_length(f["link"]) - 4)
        title = F.regexp_extract(f["url"], r"(?s)title=(.*?)&", 1)
        ours = F.coalesce(url_host(f["url"]) == domain, F.lit(False)) & f["url"].rlike(r"(?s)title=.*?&")
        none = F.lit(None).cast("string")
        return (
            F.when(f["wiki"] & (f["link"] != ""), F.struct(page_name(page), page_heading(page), none))
            .when(f["wiki"] | (f["url"] == ""), F.struct(none, none, F.lit("invalid")))
            .when(ours, F.struct(title, none, none))
            .otherwise(F.struct(none, none, F.lit("external")))
        )

    parsed = F.transform(F.array(found), read)[0]
    return parsed.cast("struct<name:string,heading:string,error:string>")


def clean_wikitext(text: Column | str) -> Column:
    """Undo the ``{{end}}`` table trick and drop comments."""
    closed = F.replace(_col(text), F.lit("{{end}}"), F.lit("|}"))
    return F.regexp_replace(closed, r"(?s)<!--.*?-->", "")


def extract_links(text: Column | str) -> Column:
    """Link targets in document order, repeats kept, labels and images skipped."""
    plain = F.regexp_replace(_col(text), r"(?is)<nowiki>.*?</nowiki>|<!--.*?-->", "")
    plain = F.regexp_replace(plain, _IMAGE, "")
    targets = F.regexp_extract_all(plain, F.lit(LINK), 1)
    return F.filter(targets, lambda t: ~t.rlike(_CATEGORY))


def plain_text(text: Column | str) -> Column:
    """Readable text up to the first ``<br>``: labels for links, no markup."""
    out = F.regexp_replace(_col(text), r"(?is)<br\b.*$", "")
    out = F.regexp_replace(out, r"(?is)<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref>", "")
    out = F.regexp_replace(out, _IMAGE, "")
    out = F.regexp_replace(out, r"(?s)\[\[(?:[^\[\]|]*\|)?([^\[\]]*+)\]\]", "$1")
    out = F.regexp_replace(out, r"(?s)\{\{(?:[^{}]++|\{\{[^{}]*+\}\})*+\}\}", "")
    out = F.regexp_replace(out, r"<[^>]*>|'{2,}", "")
    return F.trim(F.regexp_replace(out, r"^\s+|\s+$", ""))


def entity_name(name_param: Column | str, page: Column | str) -> Column:
    """Display name from the box, or the page's own name."""
    return F.coalesce(F.nullif(plain_text(name_param), F.lit("")), _col(page))


def first_paragraph(text: Column | str) -> Column:
    return F.regexp_extract(_col(text), r"^[^\n]*", 0)


def first_sentence(text: Column | str) -> Column:
    """Up to and with the first full stop; all of it when there is none."""
    text = _col(text)
    return F.when(text.contains("."), F.concat(F.substring_index(text, ".", 1), F.lit("."))).otherwise(text)


def snippet(text: Column | str, n: int = 200) -> Column:
    """First paragraph, cut at ``n`` characters and right-trimmed when cut."""
    whole = first_paragraph(text)
    short = F.regexp_replace(F.substring(whole, 1, n), r"\s+$", "")
    return F.when(F.char_length(whole) > n, short).otherwise(whole)


MIX = "struct<kind:string,id:string,note:string>"


def parse_mixes(raw: Column | str) -> Column:
    """``struct(kind, help_reason, items)`` of one mix file.

    A file is either a call for help, with or without a reason, or one address
    per line.  A note after ``#`` is cut off before the address is read.
    """
    body = F.regexp_replace(_col(raw), r"^\s+|\s+$", "")
    is_help = body.startswith("help:") | (body == "help")
    reason = F.when(body.startswith("help:"), F.regexp_replace(F.substr(body, F.lit(6)), r"^\s+|\s+$", ""))

    def item(line: Column) -> Column:
        line = F.regexp_replace(line, r"^\s+|\s+$", "")
        url = F.regexp_replace(F.substring_index(line, "#", 1), r"\s+$", "")
        at = F.instr(line, "#")
        note = F.when(at > 0, F.regexp_replace(F.substr(line, at + 1), r"^\s+|\s+$", ""))
        playlist = F.regexp_extract(url, r"list=([^&#]*)", 1)
        video = F.when(url.contains("v="), F.regexp_extract(url, r"v=([^&#]*)", 1)).when(
            url.contains("youtu.be/"), F.regexp_extract(url, r"([^/&#]*)(?:[&#][^/]*)?$", 1)
        )
        kind = F.when(url.contains("list="), F.lit("playlist")).when(video.isNotNull(), F.lit("video"))
        ident = F.when(url.contains("list="), playlist).otherwise(video)
        return F.struct(kind.alias("kind"), ident.alias("id"), note.alias("note"))

    lines = F.transform(F.split(body, r"\r?\n"), item)
    items = F.filter(lines, lambda i: i["kind"].isNotNull())
    empty = F.array().cast(f"array<{MIX}>")
    return F.struct(
        F.when(is_help, F.lit("help")).otherwise(F.lit("mixes")).alias("kind"),
        reason.alias("help_reason"),
        F.when(is_help, empty).otherwise(items).alias("items"),
    )


def template_name(raw: Column | str) -> Column:
    """Lookup form of a template name."""
    name = F.regexp_replace(_col(raw), r"^\s+|\s+$", "")
    name = F.regexp_replace(name, r"^template:", "")
    return F.lower(F.replace(name, F.lit(" "), F.lit("_")))


def _leading_template_end(text: str) -> int:
    depth = 0
    for brace in re.finditer(r"\{\{|\}\}", text):
        depth += 1 if brace.group() == "{{" else -1
        if depth == 0:
            return brace.end()
    return 0


def _strip_name(label: str, text: str) -> str:
    name = re.escape(label)
    if text.startswith("{{"):
        end = _leading_template_end(text)
        loose = r"[\s-]".join(re.escape(word) for word in re.split(r"\s+", label))
        if end and re.search(loose, text[:end], re.I):
            return text[end:].strip()
    bold, found = re.subn(rf"\A(?:The\s+)?'''{name}'''\s*", "", text, count=1, flags=re.I)
    if found:
        return bold.removeprefix(", ")
    return re.sub(rf"\A(?:The\s+)?{name}\s*", "", text, count=1, flags=re.I)


@F.pandas_udf(T.StringType())
def _strip_names(labels: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series(
        [None if t is None else t if n is None else _strip_name(n, t) for n, t in zip(labels, texts)],
        dtype=object,
    )


def strip_name_prefix(label: Column | str, text: Column | str) -> Column:
    """Drop the entity's own name from the start of its description."""
    return _strip_names(_col(label), _col(text))
