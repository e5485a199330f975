"""Page names, file names, URLs and the normal form used for matching."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters not allowed in file names and their stand-ins.
FILE_UNSAFE = "/\\:*?\"<>|#"
FILE_SAFE = "⧸⧵∶✱？❞❮❯❘❏"

# Stored edge type codes.
EDGE_TYPES = {"Derivative": 0, "Subgenre": 1, "FusionGenre": 2}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def page_name(page: Column | str) -> Column:
    """Part of ``name#heading`` before the first ``#``."""
    return F.substring_index(_col(page), "#", 1)


def page_heading(page: Column | str) -> Column:
    """Part after the first ``#``, null when there is none."""
    page = _col(page)
    at = F.instr(page, "#")
    return F.when(at > 0, F.substr(page, at + 1))


def page_parse(page: Column | str) -> Column:
    return F.struct(page_name(page).alias("name"), page_heading(page).alias("heading"))


def page_format(name: Column | str, heading: Column | str) -> Column:
    return F.concat_ws("#", _col(name), _col(heading))


def with_heading(page: Column | str, heading: Column | str) -> Column:
    """Replace the heading; a null heading gives the root page."""
    return page_format(page_name(page), heading)


def root_page(page: Column | str) -> Column:
    return page_name(page)


def page_order(page: Column | str) -> list[Column]:
    """Sort keys of the page order: name bytes, then no heading first."""
    return [page_name(page).asc(), page_heading(page).asc_nulls_first()]


def sanitize(page: Column | str) -> Column:
    return F.translate(_col(page), FILE_UNSAFE, FILE_SAFE)


def unsanitize(file_name: Column | str) -> Column:
    return F.translate(_col(file_name), FILE_SAFE, FILE_UNSAFE)


def page_url(domain: Column | str, page: Column | str) -> Column:
    """Address of a page: spaces of the name become ``_``, the heading stays."""
    name = F.replace(page_name(page), F.lit(" "), F.lit("_"))
    return F.concat(F.lit("https://"), _col(domain), F.lit("/wiki/"), page_format(name, page_heading(page)))


def dump_url(db_name: Column | str, dump_date: Column | str) -> Column:
    day = F.replace(_col(dump_date).cast("string"), F.lit("-"), F.lit(""))
    return F.concat(F.lit("https://dumps.wikimedia.org/"), _col(db_name), F.lit("/"), day, F.lit("/"))


def url_host(url: Column | str) -> Column:
    """Text between ``://`` and the next ``/``; null when either is missing."""
    return F.nullif(F.regexp_extract(_col(url), r"^(?s:.*?)://([^/]*)/", 1), F.lit(""))


def dump_date(file_name: Column | str, db_name: str = "enwiki") -> Column:
    """Date in ``<db>-YYYYMMDD-…``; null when the part is not eight digits."""
    digits = F.regexp_extract(_col(file_name), rf"^{db_name}-([0-9]{{8}})(?:-|$)", 1)
    return F.to_date(F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMdd")))


def _fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    kept = (c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c)[0] != "M")
    return "".join(c.lower() for c in kept)


# Hangul syllables are numbered by their leading, vowel and trailing letters.
HANGUL_FIRST, LEADING, VOWELS, TRAILING = 0xAC00, 19, 21, 28
HANGUL_LAST = HANGUL_FIRST + LEADING * VOWELS * TRAILING - 1


@cache
def _folding() -> tuple[str, str]:
    """The characters that folding changes, and what they become; those without a counterpart go.

    Every character but a Hangul syllable folds to one character or to none.
    """
    changed: dict[str, str] = {}
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if HANGUL_FIRST <= code <= HANGUL_LAST or unicodedata.category(char) == "Cs":
            continue
        folded = _fold(char)
        if folded != char:
            changed[char] = folded
    kept = [c for c in changed if changed[c]]
    gone = [c for c in changed if not changed[c]]
    return "".join(kept + gone), "".join(changed[c] for c in kept)


def _letters(first: int, number: Column, n: int) -> Column:
    return F.substr(F.lit("".join(chr(first + i) for i in range(n))), number + 1, F.lit(1))


def _spelled(run: Column) -> Column:
    """A Hangul syllable as its letters; any other run as it is."""
    at = F.ascii(run) - HANGUL_FIRST
    leading = _letters(0x1100, F.floor(at / (VOWELS * TRAILING)).cast("int"), LEADING)
    vowel = _letters(0x1161, F.floor(at / TRAILING).cast("int") % VOWELS, VOWELS)
    tail = at % TRAILING
    trailing = F.when(tail > 0, _letters(0x11A8, tail - 1, TRAILING - 1)).otherwise("")
    syllable = (at >= 0) & (at <= HANGUL_LAST - HANGUL_FIRST)
    return F.when(syllable, F.concat(leading, vowel, trailing)).otherwise(run)


def normalize_text(text: Column | str) -> Column:
    """Decompose, drop combining marks, lower-case each character: column functions only."""
    text = _col(text)
    folded = F.translate(text, *_folding())
    hangul = f"{chr(HANGUL_FIRST)}-{chr(HANGUL_LAST)}"
    runs = F.regexp_extract_all(folded, F.lit(f"[{hangul}]|[^{hangul}]+"), F.lit(0))
    spelled = F.array_join(F.transform(runs, _spelled), "")
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).when(folded.rlike(f"[{hangul}]"), spelled).otherwise(folded)


def strip_qualifier(title: Column | str) -> Column:
    """Remove one trailing `` (…)`` unless nothing would be left."""
    return F.regexp_replace(_col(title), r"(?s)^(.+) \((?!.* \().*\)$", "$1")


def display_title(page_title: Column | str, label: Column | str) -> Column:
    """The page title, null when it only repeats the label."""
    return F.nullif(_col(page_title), _col(label))


def edge_type_code(name: Column | str) -> Column:
    name = _col(name)
    code = F.raise_error(F.concat(F.lit("unknown edge type: "), name)).cast("tinyint")
    for label, value in EDGE_TYPES.items():
        code = F.when(name == label, F.lit(value).cast("tinyint")).otherwise(code)
    return code


def edge_type_name(code: Column | str) -> Column:
    code = _col(code)
    name = F.raise_error(F.concat(F.lit("unknown edge type: "), code.cast("string"))).cast("string")
    for label, value in EDGE_TYPES.items():
        name = F.when(code == value, F.lit(label)).otherwise(name)
    return name
