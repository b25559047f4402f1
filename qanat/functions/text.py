"""Text columns: folding, tokens, windows of words.  All native expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qanat.config import ChunkConfig

#: White space that separates words.
SPACE = r"[ \t\n\r\f\x0B]"
WORD = r"[^ \t\n\r\f\x0B]+"


@dataclass(frozen=True)
class Folding:
    """Characters to drop, characters to replace one by one, and the proclitics to cut once."""

    drop: str
    source: str
    target: str
    clitics: str = ""


# Arabic marks, letter variants and proclitics.
ARABIC = Folding(
    drop="[ً-ٰٟـ]",
    source="أإآٱىةؤ",
    target="اااايهو",
    clitics="^(و|ف|ب|ل|ك)?(ال)?",
)
LATIN = Folding(
    drop="[̀-ͯ]",
    source="àáâãäåçèéêëìíîïñòóôõöùúûü",
    target="aaaaaaceeeeiiiinooooouuuu",
    clitics="^(qu|de)?(la|le)?",
)


def fold(text: Column, folding: Folding = ARABIC, collapse: bool = True) -> Column:
    """Drops marks and maps variants; ``collapse`` also trims and joins white space.  Null gives ''."""
    out = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), folding.drop, ""), folding.source, folding.target)
    return F.trim(F.regexp_replace(out, f"{SPACE}+", " ")) if collapse else out


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def strip_clitics(token: Column, folding: Folding = ARABIC) -> Column:
    """The token without its proclitics, or whole if fewer than two characters stay."""
    cut = F.regexp_replace(token, folding.clitics, "")
    return F.when(F.length(cut) >= 2, cut).otherwise(token)


def tokens(text: Column, folding: Folding = ARABIC) -> Column:
    """Folded words of at least two characters, proclitics cut.  Case and punctuation stay."""
    kept = F.filter(words(fold(text, folding, collapse=False)), lambda t: F.length(t) >= 2)
    return F.transform(kept, lambda t: strip_clitics(t, folding)) if folding.clitics else kept


def plain_tokens(text: Column) -> Column:
    """Lower-case words of at least two characters."""
    return F.filter(words(F.lower(text)), lambda t: F.length(t) >= 2)


def metric_tokens(text: Column, folding: Folding = ARABIC) -> Column:
    """The set of runs of letters, digits and underscores of the folded lower-case text."""
    low = F.lower(fold(text, folding, collapse=False))
    return F.array_distinct(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def windows(df: DataFrame, column: str, out: str, config: ChunkConfig = ChunkConfig(), joined: bool = True) -> DataFrame:
    """Adds ``out``: the overlapping word windows of a text column, an array of strings
    (of word arrays unless ``joined``).

    Window s exists if the one before ended short of the last word, that is for
    s = 0, stride, 2 stride ... up to the number of words less the overlap less 1.
    The words are a projection of their own, so that they are made once a row
    and not once a window.  There is always a window: explode with the outer form,
    else the optimizer infers a filter that makes the windows a second time.
    """
    w = F.col("__words")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - config.overlap - 1), F.lit(config.size - config.overlap))
    part = lambda s: F.slice(w, s + 1, F.lit(config.size))
    made = F.transform(starts, lambda s: F.array_join(part(s), " ") if joined else part(s))
    return df.withColumn("__words", words(F.col(column))).withColumn(out, made).drop("__words")
