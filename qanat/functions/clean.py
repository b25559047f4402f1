"""Cleaning of scraped article bodies: an ordered list of native replacements.

The order is part of the meaning: escapes go before the cuts that look for what
they hid, cuts before mark-up, mark-up before white space.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names used inside patterns.
DAYS = "(الأحد|الإثنين|الثلاثاء|الأربعاء|الخميس|الجمعة|السبت)"
MONTHS = "(January|February|March|April|May|June|July|August|September|October|November|December)"


@dataclass(frozen=True)
class CleanRules:
    #: Domain of the crawled site, as a pattern, and the name in its bylines.
    domain: str = r"news\.example"
    byline: str = "Example"
    least_cut: int = 200
    title_min: int = 10
    title_head: int = 20


def before_cuts(rules: CleanRules) -> list[tuple[str, str]]:
    # Patterns and replacements up to the removal of backslashes.
    return [
        (r"\[\]\(https?://[^\)]+\)\s*", ""),
        (r"(?=ال)" + DAYS + r"[،,]\s*\d{1,2}\s+\w+\s+\d{4}\s*[-–]\s*\d{2}:\d{2}\s*", ""),
        (rf"كتب\s*:\s*{rules.byline}\s*", ""),
        (r"\*\*\d+\*\*\s*\\\\\s*[^\*\n]{2,40}\s*\\\\\s*\*\*\d+\*\*\s*\\\\\s*[^\*\n]{2,40}\s*\\\\\s*\*\*[^\*\n]+\*\*", ""),
        (r"انتهت\d{2}:\d{2}\s*", ""),
        (r"\bvideo:\d+\b", ""),
        (r"https?://pic\.twitter\.com/\S+", ""),
        (r"pic\.twitter\.com/\S+", ""),
        (r"#[\w؀-ۿ]+(?:\\_[\w؀-ۿ]+)*", ""),
        (r"(?m)^>\s*", " "),
        (rf"https?://(?:www\.)?{rules.domain}/\S*", ""),
        (rf"(?:www\.)?{rules.domain}/\S*", ""),
        (rf"\b{rules.domain}\b", ""),
        (r"\\+", " "),
    ]


# Where a news ticker starts, and what separates related articles.
TICKER = r"\d+\s+دقيقة\s+\||\bساعة\s+\|"
RELATED = " __ "

# Patterns and replacements after the cuts.
AFTER_CUTS = [
    (r"/articles/\d+\S*", ""),
    (r"(?s)\bClient\b.*$", ""),
    (r"(?is)هايترز\s*تي\s*في.*?(?:يوتيوب|YouTube|اشترك)[^\n]*", ""),
    (r"(?i)\bYouTube\b[^\n]*", ""),
    (r"(?i)\d[\d,\.]*\s*(?:مشترك|subscriber)[^\n]*", ""),
    (r"(?i)@beIN\w*", ""),
    (r"(?i)beIN\s*Sports?\s*(?:عربي|العربية|Arabic)?", ""),
    (r"\b\d{1,2}\s+" + MONTHS + r"\s+\d{4}\b", ""),
    (r"(?=[ADFJMNOS])" + MONTHS + r"\s+\d{1,2},?\s+\d{4}\b", ""),
    (r"_\*\*([^\*\n]+)\*\*_", "$1"),
    (r"\*\*_([^_\n]+)_\*\*", "$1"),
    (r"[\x{1F300}-\x{1F9FF}\x{2600}-\x{27FF}\x{FE00}-\x{FE0F}\x{1FA00}-\x{1FA9F}]+", ""),
    (r"\*\*([^\*\n]+)\*\*", "$1"),
    (r"\*([^\*\n]+)\*", "$1"),
    (r"#{1,6}\s+", ""),
    (r"\[([^\]]+)\]\([^\)]+\)", "$1"),
    (r"\[\]\([^\)]+\)", ""),
    (r"!\[[^\]]*\]\([^\)]+\)", ""),
    (r"<[^>]+>", ""),
    (r"صورة\s*:\s*\S+", ""),
    (r"(?i)Getty\s*(Images?)?", ""),
    (r"\b(\S{4,})\s+\1\b", "$1"),
    (r"[ \t]{2,}", " "),
]


#: What every match of a pattern (given by its beginning) holds one of.  A text without them is not searched by
#: regular expression at all: most steps find nothing in most texts.
NEEDS = {
    r"[](http": (r"\[\]\(https?",), "ال": (r"(?=ال)" + DAYS,), "كتب": (r"كتب\s*",), "**": (r"\*\*\d+\*\*", r"\*\*([^\*\n]+)\*\*"), "انتهت": ("انتهت",), "video:": (r"\bvideo:",),
    "pic.twitter.com/": (r"https?://pic\.twitter\.com/", r"pic\.twitter\.com/"), "#": (r"#[\w", "#{1,6}"), ">": ("(?m)^>",), "\\": (r"\\+",), "/articles/": ("/articles/",), "Client": (r"(?s)\bClient\b",),
    "هايترز": ("(?is)هايترز",), "@": ("(?i)@beIN",), "_**": (r"_\*\*",), "**_": (r"\*\*_",), "*": (r"\*([^\*\n]+)\*",), "](": (r"\[([^\]]+)\]\(",), "[](": (r"\[\]\([^",), "![": (r"!\[",),
    "<": ("<[^>]+>",), "صورة": ("صورة",),
}
BLANKS, BEYOND = r"[ \t]{2,}", r"[\x{1F300}"


def needed(pattern: str, text: Column, rules: CleanRules | None = None) -> Column | None:
    """Whether ``text`` may have a match of ``pattern``; None: not known without searching."""
    if pattern.startswith(BEYOND):  # characters beyond ASCII
        return F.octet_length(text) > F.length(text)
    if pattern == BLANKS:
        return F.contains(text, F.lit("  ")) | F.contains(text, F.lit("\t"))
    if rules is not None and rules.domain in pattern and re.fullmatch(r"(?:[\w-]|\\\.)+", rules.domain):
        return F.contains(text, F.lit(rules.domain.replace("\\.", ".")))
    found = next((x for x, starts in NEEDS.items() if pattern.startswith(starts)), None)
    return None if found is None else F.contains(text, F.lit(found))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def replace_all(text: Column, steps: list[tuple[str, str]], rules: CleanRules | None = None) -> Column:
    def step(pattern, to):
        return lambda t: F.when(needed(pattern, t, rules), F.regexp_replace(t, "(?U)" + pattern, to)).otherwise(t)

    for pattern, to in steps:
        text = bound(text, step(pattern, to)) if needed(pattern, text, rules) is not None else F.regexp_replace(text, "(?U)" + pattern, to)
    return text


def collapse_repeats(text: Column) -> Column:
    """One of two equal neighbouring words of at least four characters."""
    return F.regexp_replace(text, r"(?U)\b(\S{4,})\s+\1\b", "$1")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clean_body(text: Column, title: Column | None = None, rules: CleanRules = CleanRules()) -> Column:
    """The readable body.  Null gives ''."""

    def without_ticker(t: Column) -> Column:
        cut = F.regexp_replace(t, r"(?Us)(?:" + TICKER + r").*$", "")
        return F.when(F.contains(t, F.lit("|")), bound(cut, lambda c: F.when(c != t, trimmed(c)).otherwise(t))).otherwise(t)

    def without_related(t: Column) -> Column:
        at = F.instr(t, RELATED) - 1
        return F.when(at > rules.least_cut, trimmed(F.substr(t, F.lit(1), at))).otherwise(t)

    def without_title(t: Column) -> Column:
        head = F.substring(title, 1, rules.title_head)
        starts = (F.length(title) > rules.title_min) & F.startswith(t, trimmed(head))
        return F.when(starts, trimmed(F.substr(t, F.length(head) + 1))).otherwise(t)

    t = bound(replace_all(F.coalesce(text, F.lit("")), before_cuts(rules), rules), without_ticker)
    t = trimmed(replace_all(bound(t, without_related), AFTER_CUTS))
    return t if title is None else bound(t, without_title)
