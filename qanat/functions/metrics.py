"""Evaluation metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qanat.functions.text import ARABIC, Folding, metric_tokens


def rouge1_f1(prediction: Column, reference: Column, folding: Folding = ARABIC) -> Column:
    """F1 of the sets of tokens; 0 if either is empty."""
    p, r = metric_tokens(prediction, folding), metric_tokens(reference, folding)
    both = F.size(F.array_intersect(p, r))
    return F.when(both > 0, 2.0 * both / (F.size(p) + F.size(r))).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def text_similarity(a_text: Column, b_text: Column, a: Column, b: Column) -> Column:
    """Cosine of the texts' unit vectors; 0 if either text is empty."""
    full = (F.coalesce(a_text, F.lit("")) != "") & (F.coalesce(b_text, F.lit("")) != "")
    return F.when(full, cosine(a, b)).otherwise(0.0)


def keyword_hit(texts: Column, keywords: Column, k: int | None = None) -> Column:
    """Share of the keywords contained in the first k texts (all: None); 1 without keywords."""
    joined = F.lower(F.array_join(texts if k is None else F.slice(texts, 1, k), " "))
    n = F.size(F.filter(keywords, lambda w: F.contains(joined, F.lower(w))))
    return F.when(F.size(keywords) == 0, 1.0).otherwise(n / F.greatest(F.size(keywords), F.lit(1)))


def has_keyword(text: Column, keywords: Column) -> Column:
    return F.exists(keywords, lambda w: F.contains(F.lower(text), F.lower(w)))


def reciprocal_rank(texts: Column, keywords: Column) -> Column:
    """1 / rank of the first text with a keyword, else 0."""
    at = F.array_position(F.transform(texts, lambda t: F.exists(keywords, lambda w: F.contains(F.lower(t), F.lower(w)))), True)
    return F.when(F.coalesce(at, F.lit(0)) > 0, 1.0 / at).otherwise(0.0)


def hit_at_1(texts: Column, keywords: Column) -> Column:
    return F.when(F.coalesce(has_keyword(F.get(texts, F.lit(0)), keywords), F.lit(False)), 1.0).otherwise(0.0)


def intent_accuracy(predicted: Column, expected: Column, refusal: Column) -> Column:
    """Equality; on refusal cases general and out-of-scope stand for each other."""
    pair = ["general_football", "out_of_scope"]
    return F.when((predicted == expected) | (refusal & predicted.isin(*pair) & expected.isin(*pair)), 1.0).otherwise(0.0)


def mean_or_zero(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))
