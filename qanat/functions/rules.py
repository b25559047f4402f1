"""Rule-based columns: ordered categories, lexicon tags, query routing.

A RuleSet is configuration; ``arabic_football()`` is the default one.
Patterns are Java regular expressions with Unicode classes switched on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from qanat.functions import arabic_rules as ar


@dataclass(frozen=True)
class RuleSet:
    #: (class, patterns) in order; the first class with a match wins.
    ordered: list[tuple[str, list[str]]]
    #: (class, pattern, pattern that must not match or "") tried before all else.
    overrides: list[tuple[str, str, str]] = field(default_factory=list)
    out_of_scope: list[str] = field(default_factory=list)
    default: str = "general_football"
    extractive: list[str] = field(default_factory=list)
    #: class -> article type that retrieval is filtered to
    filter_type: dict[str, str] = field(default_factory=dict)


def arabic_football() -> RuleSet:
    named = {
        "lineup": ar.LINEUP, "match_result": ar.MATCH_RESULT, "transfer_news": ar.TRANSFER_NEWS,
        "team_news": ar.TEAM_NEWS, "player_info": ar.PLAYER_INFO,
    }
    return RuleSet(
        ordered=[(n, named[n]) for n in ar.ORDER],
        overrides=[("team_news", ar.QUOTE, ""), ("player_info", ar.NAMED_PLAYER, ar.NOT_WITH_NAMED), ("player_info", ar.BACK_IN_TRAINING, "")],
        out_of_scope=ar.OUT_OF_SCOPE,
        extractive=ar.EXTRACTIVE,
        filter_type={"lineup": "lineup", "match_result": "match_result", "transfer_news": "transfer"},
    )


def any_of(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found: one alternation, so one scan of the text."""
    return F.rlike(text, F.lit("(?U)" + "|".join(f"(?:{p})" for p in patterns))) if patterns else F.lit(False)


def out_of_scope(text: Column, rules: RuleSet) -> Column:
    return any_of(F.lower(text), rules.out_of_scope)


def route(query: Column, rules: RuleSet) -> Column:
    """The class of a query: overrides, then the scope test, then the ordered classes, then the default."""
    q = F.lower(F.coalesce(query, F.lit("")))
    out = None
    for name, pattern, unless in rules.overrides:
        cond = any_of(q, [pattern])
        if unless:
            cond = cond & ~any_of(q, [unless])
        out = F.when(cond, name) if out is None else out.when(cond, name)
    scope = any_of(q, rules.out_of_scope)
    out = F.when(scope, "out_of_scope") if out is None else out.when(scope, "out_of_scope")
    for name, patterns in rules.ordered:
        out = out.when(any_of(q, patterns), name)
    return out.otherwise(rules.default)


def contains_any(text: Column, needles: list[str]) -> Column:
    cond = F.lit(False)
    for n in needles:
        cond = cond | F.contains(text, F.lit(n))
    return cond


def ordered_category(text: Column, table: list[tuple[str, list[str]]], default: str | Column) -> Column:
    """The first class of which any needle is contained in the text."""
    out = None
    for name, needles in table:
        cond = contains_any(text, needles)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return (F.when(F.lit(False), "") if out is None else out).otherwise(default)


# Article types by words of the title, in order.
ARTICLE_TYPES = [
    ("lineup", ["تشكيل", "تشكيلة"]),
    ("match_result", ["انتهت", "نتيجة", "هدف", "فاز", "تعادل"]),
    ("press_conference", ["مؤتمر", "تصريح", "قال", "يؤكد", "يكشف"]),
    ("training", ["مران", "تدريب", "محاضرة"]),
    ("transfer", ["ميركاتو", "انتقال", "صفقة", "عقد", "رحيل", "يضم", "تعاقد"]),
]


def article_type(title: Column) -> Column:
    return ordered_category(F.coalesce(title, F.lit("")), ARTICLE_TYPES, "article")


def league(title: Column, section: Column, body: Column, keywords=None, sections=None, own_section: str | None = None) -> Column:
    """First league with a keyword in title, section or the body's first 300 characters; else by section; else other.
    ``own_section`` is a section that a crawled site names after itself and fills with the Saudi league: it is configuration."""
    s = F.coalesce(section, F.lit(""))
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), s, F.substring(F.coalesce(body, F.lit("")), 1, 300))
    known = list(ar.SECTION_LEAGUES if sections is None else sections)
    if own_section:
        known.insert(3, (own_section, "saudi_league"))
    by_section = ordered_category(s, [(v, [k]) for k, v in known], "other")
    return ordered_category(text, ar.LEAGUES if keywords is None else keywords, by_section)


def lexicon_tags(text: Column, lexicon: list[tuple[str, str]] = ar.TEAMS) -> Column:
    """Ids of all lexicon names contained in the text, distinct, in lexicon order."""
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("id")) for n, i in lexicon])
    return F.array_distinct(F.transform(F.filter(entries, lambda e: F.contains(text, e["name"])), lambda e: e["id"]))
