"""Per-page scan of wiki text for info boxes and lead text.

Runs inside ``mapInPandas``: one page in, its boxes out.  It only finds where
templates, headings, references and images begin and end; everything done with
the box parameters afterwards is column work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_MARK = re.compile(
    r"(?P<heading>^(?P<level>={1,6})(?P<title>[^\n]*?[^=\n][^\n]*?)(?P=level)[ \t]*$)"
    r"|(?P<item>^[*#:;])"
    r"|(?P<nowiki><nowiki>.*?</nowiki>)"
    r"|(?P<ref><ref\b[^>]*/>|<ref\b[^>]*>(?:.*?</ref>|.*\Z))"
    r"|(?P<open>\{\{|\[\[|\{\|)",
    re.S | re.M | re.I,
)
_NEST = re.compile(r"<nowiki>.*?</nowiki>|\{\{|\}\}|\[\[|\]\]|\{\||\|\}(?!\})|\||=|\n", re.S | re.I)
_STOP = re.compile(r"\{\{|\[\[|\n")
_PAIR = {"{{": "}}", "[[": "]]", "{|": "|}"}
_IMAGE = re.compile(r"\[\[\s*(?:file|image)\s*:", re.I)

# Templates kept although no text was seen before them.
LEAD_TEMPLATES = {"nihongo", "transliteration", "tlit", "transl", "lang"}
# Fixed value: templates with this prefix are never kept.
SKIPPED_PREFIX = "use"


def _ends(text: str) -> dict[int, int]:
    """End of every bracket by its start, in one pass; an unclosed one ends where it starts."""
    ends: dict[int, int] = {}
    open_: list[tuple[str, int]] = []
    for token in _NEST.finditer(text):
        mark = token.group()
        if mark in _PAIR:
            open_.append((_PAIR[mark], token.start()))
            ends[token.start()] = token.start()
        elif open_ and mark == open_[-1][0]:
            ends[open_.pop()[1]] = token.end()
    return ends


def _line_end(text: str, start: int, ends: dict[int, int]) -> int:
    """End of a list item: the first line break outside any bracket."""
    for token in iter(lambda: _STOP.search(text, start), None):
        if token.group() == "\n":
            return token.start()
        start = max(ends.get(token.start(), 0), token.end())
    return len(text)


def _pieces(text: str) -> Iterator[tuple[str, int, int]]:
    """Top-level pieces in order: text, template, heading, ref or image."""
    ends = _ends(text)
    at = shown = 0
    while (mark := _MARK.search(text, at)) is not None:
        start, kind = mark.start(), mark.lastgroup
        if mark.group("heading"):
            kind, end = "heading", mark.end()
        elif mark.group("ref"):
            kind, end = "ref", mark.end()
        elif mark.group("item"):
            at = _line_end(text, mark.end(), ends)
            continue
        elif mark.group("nowiki"):
            at = mark.end()
            continue
        else:
            end = ends.get(start, start)
            if end == start or mark.group() == "{|":
                at = max(end, mark.end())
                continue
            kind = "template" if mark.group() == "{{" else "image"
            if kind == "image" and not _IMAGE.match(text, start):
                at = end
                continue
        if start > shown:
            yield "text", shown, start
        yield kind, start, end
        at = shown = end
    if shown < len(text):
        yield "text", shown, len(text)


def _template(text: str) -> tuple[str, dict[str, str]]:
    """Lower-cased name and named parameters of one ``{{…}}``; last one wins."""
    depth, begin, equals, parts = 0, 2, -1, []
    for token in _NEST.finditer(text, 2, len(text) - 2):
        mark = token.group()
        if mark in _PAIR:
            depth += 1
        elif mark in ("}}", "]]", "|}"):
            depth -= 1
        elif depth == 0 and mark == "|":
            parts.append((begin, equals, token.start()))
            begin, equals = token.end(), -1
        elif depth == 0 and mark == "=" and equals < 0:
            equals = token.start()
    parts.append((begin, equals, len(text) - 2))
    named = {text[b:e].strip(): text[e + 1 : end].strip() for b, e, end in parts[1:] if e >= 0}
    first, _, last = parts[0]
    return text[first:last].strip().lower(), named


def _box_parameters(text: str, wanted: str) -> tuple[str, dict[str, str] | None]:
    """Template name, and its parameters if it is, or carries, the wanted box."""
    name, params = _template(text)
    if name == wanted:
        return name, params
    module = params.get("module", "")
    for kind, start, end in _pieces(module):
        if kind == "template":
            inner, inner_params = _template(module[start:end])
            if inner == wanted:
                return name, {**params, **inner_params}
    return name, None


def _heading_text(line: str) -> str:
    bare = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", r"\1", line.strip().strip("="))
    return re.sub(r"'{2,}|<[^>]*>", "", bare).strip()


def page_boxes(text: str, wanted: str) -> list[dict]:
    """Boxes of one page: heading above, parameters and the lead text after it."""
    boxes: dict[str | None, dict] = {}
    current: dict | None = None
    lead: str | None = None
    heading: str | None = None

    def close() -> None:
        if current is not None and lead is not None:
            current["description"] = lead.strip()

    for kind, start, end in _pieces(text):
        piece = text[start:end]
        if kind == "template":
            name, params = _box_parameters(piece, wanted)
            if lead is not None and not name.startswith(SKIPPED_PREFIX):
                if lead.strip() or name in LEAD_TEMPLATES:
                    lead += piece
            if params is not None:
                close()
                current = {"heading": heading, "params": params, "description": None}
                boxes.pop(heading, None)
                boxes[heading] = current
                lead = ""
        elif kind == "heading":
            if lead is not None and lead.strip():
                close()
                lead = None
            heading = _heading_text(piece)
        elif kind == "text" and lead is not None:
            lead += piece
    close()
    return list(boxes.values())
