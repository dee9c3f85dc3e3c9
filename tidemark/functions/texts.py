"""Columns on text: tokens, keys, flags and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HAN = r"\x{4e00}-\x{9fff}"
#: A character of a lower-cased text that is or begins a token.
TOKEN = f"[a-z0-9_{_HAN}]"
#: Fixed value: the marks that a title key leaves out.
_TITLE_MARKS = r"[@#《》【】\[\]（）()，,。.!！?？:：;；\"'“”‘’、\s]+"


def blank(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def token_list(text: Column) -> Column:
    """Latin words and single Han characters in order, then pairs and triples of neighbouring Han characters.

    Neighbours are counted among the Han characters alone, so grams reach over latin words between them.
    """
    words = F.regexp_extract_all(F.lower(blank(text)), F.lit(f"[a-z0-9_]+|[{_HAN}]"), F.lit(0))
    han = F.filter(words, lambda w: w.rlike(f"^[{_HAN}]$"))
    pairs = F.filter(F.zip_with(han, F.slice(han, F.lit(2), F.size(han)), lambda a, b: F.concat(a, b)), lambda x: x.isNotNull())
    triples = F.filter(F.zip_with(pairs, F.slice(han, F.lit(3), F.size(han)), lambda a, b: F.concat(a, b)), lambda x: x.isNotNull())
    # most texts have no Han characters, whose words needn't be searched for them one by one
    return F.when(~blank(text).rlike(f"[{_HAN}]"), words).when(F.size(han) < 2, words).otherwise(F.concat(words, pairs, triples))


def token_set(text: Column) -> Column:
    return F.array_distinct(token_list(text))


def title_key(title: Column) -> Column:
    """Key under which titles that differ in links, marks, spaces or numbers are one: its first 80 characters.

    Where the beginning of a long text gives more than these, the rest can't change them and isn't searched.
    """

    def whole(text):
        text = F.regexp_replace(F.lower(F.trim(text)), r"https?://\S+", "")
        return F.regexp_replace(F.regexp_replace(text, _TITLE_MARKS, ""), r"\d+", "#")

    few, more = (whole(F.substring(F.ltrim(blank(title)), 1, n)) for n in (240, 800))  # a link or number that is cut changes less than 16 characters
    return F.substring(F.when(F.length(few) > 96, few).when(F.length(more) > 96, more).otherwise(whole(blank(title))), 1, 80)


def diversity_key(col: Column) -> Column:
    """The value's parts, each once and in order; blank for a missing value."""
    text = F.lower(F.trim(blank(col)))
    parts = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, r"[|,，/、\s]+"), F.trim), lambda p: p != "")))
    return F.when(text.isin("", "unknown", "none", "null"), "").otherwise(F.substring(F.array_join(parts, "|"), 1, 100))


def fingerprint(col: Column) -> Column:
    """Letters and digits of the text, lower-cased, 80 at most; blank if there are under eight."""
    text = F.regexp_replace(F.lower(blank(col)), r"[^\p{L}\p{N}]+", "")
    return F.when(F.length(text) < 8, "").otherwise(F.substring(text, 1, 80))


def contains_any(text: Column, words: list[str]) -> Column:
    low = F.lower(blank(text))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w.lower()))
    return out


def keyword_hits(text: Column, words: list[str]) -> Column:
    """How many different words the text contains."""
    low = F.lower(blank(text))
    return sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0))


def keyword_score(text: Column, words: list[str], each: int = 16) -> Column:
    return F.least(F.lit(100), keyword_hits(text, words) * each)


def quality_score(text: Column, seconds: Column) -> Column:
    """Density of characters in time (.65) and variety of characters (.35), 0..1."""
    chars = F.regexp_replace(blank(text), r"\s+", "")
    n = F.length(chars)
    kinds = F.size(F.array_distinct(F.filter(F.split(chars, ""), lambda c: c != "")))
    density = F.least(F.lit(1.0), n / F.greatest(F.lit(1.0), seconds * 4))
    return F.when(n == 0, F.lit(0.0)).otherwise(0.65 * density + 0.35 * F.least(F.lit(1.0), kinds / F.greatest(F.lit(1.0), n.cast("double"))))


def latin_ratio(text: Column) -> Column:
    """Share of latin letters among all characters but white space."""
    chars = F.regexp_replace(blank(text), r"\s+", "")
    return F.when(F.length(chars) == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(chars, "[^A-Za-z]", "")) / F.length(chars))


def repeats_itself(text: Column) -> Column:
    """A short stretch six times over, or one word four times in a row."""
    low = F.lower(blank(text))
    return low.rlike(r"(.{1,6})\1{5,}") | low.rlike(r"\b(\w+)(?:\W+\1\b){3,}")


def collapse_repeats(text: Column) -> Column:
    """A text that is one stretch written twice or more becomes that stretch."""
    return F.regexp_replace(F.trim(blank(text)), r"^(.{2,}?)\s*(?:\1\s*)+$", "$1")


def split_values(col: Column) -> Column:
    """Parts of a multi-value cell, without number signs, each once, in order."""
    parts = F.transform(F.split(blank(col), r"[|,，、;；\n]+"), lambda p: F.regexp_replace(F.trim(p), "^[# ]+|[# ]+$", ""))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def hashtags(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(blank(text), F.lit(r"#([^\s#@]+)"), F.lit(1)))


def mentions(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(blank(text), F.lit(r"@([^\s#@]+)"), F.lit(1)))


def song_title(text: Column) -> Column:
    """What stands in the first pair of title brackets; blank without one."""
    return F.regexp_extract(blank(text), r"《([^》]{1,40})》", 1)


def plain_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags go, the common entities are resolved, white space collapses."""
    body = F.regexp_replace(blank(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        body = F.replace(body, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(body, r"\s+", " "))


def shared_share(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token sets."""
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.lit(1), F.size(a) + F.size(b) - both)
