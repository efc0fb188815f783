"""Query and index text as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W

Text = Column | str


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def normalize(c: Text) -> Column:
    """Lower case, ё as е, anything but letters, digits, ``_``, ``-`` and white space as a space, single spaces."""
    kept = F.regexp_replace(F.translate(F.lower(col(c)), "ё", "е"), r"(?U)[^\w\s\-]", " ")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def _words(c: Text, separators: str = r"(?U)\s+") -> Column:
    return F.filter(F.split(col(c), separators), lambda w: w != "")


def tokenize(c: Text, stop_words=W.STOP_WORDS) -> Column:
    """Tokens of a normalized text, in order.

    A word that is no stop word and longer than 1 is a token each time it occurs. One with a hyphen is followed by its
    joined form and its parts, each if longer than 1 (a part also only if no stop word) and not yet among the tokens.
    """
    long, stops = lambda w: F.length(w) > 1, lambda w: w.isin(*stop_words)

    def candidates(word: Column, at: Column) -> Column:
        """(token, at, place): place 0 is a word itself, which is a token always; the others are tokens where they come first."""
        parts = F.concat(F.array(F.replace(word, F.lit("-"), F.lit(""))), F.transform(F.split(word, "-"), lambda p: F.when(stops(p), F.lit("")).otherwise(p)))
        forms = F.when(F.contains(word, F.lit("-")), F.concat(F.array(word), parts)).otherwise(F.array(word))
        return F.filter(F.transform(forms, lambda f, place: F.struct(f.alias("token"), at.alias("at"), place.alias("place"))), lambda f: long(f["token"]))

    def hyphenated(words: Column) -> Column:
        # Sorted, so that a candidate is compared with its neighbour and not with all tokens before it.
        every = F.sort_array(F.flatten(F.transform(words, candidates)))
        first = lambda s: F.filter(s, lambda f, k: (f["place"] == 0) | (k == 0) | (F.get(s, k - 1)["token"] != f["token"]))
        placed = F.transform(_once(every, first), lambda f: F.struct(f["at"], f["place"], f["token"]))
        return F.transform(F.sort_array(placed), lambda f: f["token"])

    def tokens(text: Column) -> Column:
        words = F.filter(_words(text), lambda w: ~stops(w))
        return F.when(F.contains(text, F.lit("-")), hyphenated(words)).otherwise(F.filter(words, long))

    return _once(col(c), tokens)


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def tokenize_split(c: Text, stop_words=W.LONG_STOP_WORDS) -> Column:
    """Tokens cut at white space and hyphens, without stop words and single characters."""
    stop = _strings(stop_words)
    return F.filter(F.split(col(c), r"(?U)[\s\-]+"), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def convert_layout(c: Text, to_russian: bool = True) -> Column:
    """What the same keys give in the other keyboard layout."""
    return F.translate(F.lower(col(c)), *((W.LATIN_KEYS, W.RUSSIAN_KEYS) if to_russian else (W.RUSSIAN_KEYS, W.LATIN_KEYS)))


def layout_variants(normalized: Text) -> Column:
    """The text in the Russian layout if that differs, then in the Latin one if that differs from both."""
    text = col(normalized)
    russian, latin = convert_layout(text), convert_layout(text, False)
    return F.filter(F.array(F.when(russian != text, russian), F.when((latin != text) & (latin != russian), latin)), lambda v: v.isNotNull())


def query_variants(c: Text) -> Column:
    n = normalize(c)
    return F.concat(F.array(n), layout_variants(n))


def wrong_layout(c: Text) -> Column:
    """Whether a text has Cyrillic or Latin letters but not both."""
    low = F.lower(col(c))
    return low.rlike("[а-яё]") != low.rlike("[a-z]")


def ngrams(c: Text, n: int = 3) -> Column:
    """Character n-grams; a shorter text is its own only one."""
    text = col(c)
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))


def padded_ngrams(c: Text, n: int = 3, prefix_only: bool = False) -> Column:
    pad = "_" * (n - 1)
    return ngrams(F.concat(F.lit(pad), col(c), F.lit("" if prefix_only else pad)), n)


def stem(c: Text) -> Column:
    """The first ending, in the list's order, that leaves 2 characters or more is cut; short words stay."""
    text = col(c)
    out = F.when(F.length(text) <= 3, text)
    for e in W.ENDINGS:
        out = out.when(F.endswith(text, F.lit(e)) & (F.length(text) >= len(e) + 2), F.substring(text, F.lit(1), F.length(text) - len(e)))
    return out.otherwise(text)


def transliterate(c: Text, to_cyrillic: bool = True) -> Column:
    out = F.lower(col(c))
    groups, letters, last = (W.TO_CYRILLIC_GROUPS, W.TO_CYRILLIC_LETTERS, W.TO_CYRILLIC_LAST) if to_cyrillic else (W.TO_LATIN_GROUPS, W.TO_LATIN_LETTERS, ())
    for a, b in groups:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.translate(out, *letters)
    for a, b in last:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def spelling_variants(c: Text) -> Column:
    """A word, and its transliteration if it is all Latin or all Cyrillic and the two differ."""
    word = col(c)
    other = F.when(word.rlike("^[a-zA-Z]+$"), transliterate(word)).when(word.rlike("^[а-яёА-ЯЁ]+$"), transliterate(word, False))
    return F.filter(F.array(word, F.when(other != word, other)), lambda v: v.isNotNull())


def is_known_brand(c: Text) -> Column:
    return F.lower(col(c)).isin(*W.KNOWN_BRANDS)


def strip_html(c: Text) -> Column:
    """Without tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), "<[^>]+>", ""), r"(?U)\s+", " "))


def parse_price(c: Text) -> Column:
    """A comma is a point, spaces go, then everything but digits and points; nothing left is 0, nonsense null."""
    digits = F.regexp_replace(F.translate(col(c).cast("string"), ", ", "."), "[^0-9.]", "")
    return F.when(F.coalesce(digits, F.lit("")) == "", F.lit(0.0)).otherwise(digits.try_cast("double"))


def parse_delta_price(c: Text) -> Column:
    """A comma is a point, spaces go; what is no number then is null."""
    return F.translate(col(c).cast("string"), ",  ", ".").try_cast("double")


def parse_bool(c: Text, words=W.TRUE_WORDS) -> Column:
    return F.coalesce(F.lower(col(c).cast("string")).isin(*words), F.lit(False))


def highlight(c: Text, tokens: list[str]) -> Column:
    """Each token's matches, whatever their case, in ``<em>``; one token after the other."""
    out = col(c)
    for t in tokens:
        out = F.regexp_replace(out, "(?iu)" + re.sub(r"([^\w\s])", r"\\\1", t), "<em>$0</em>")
    return out


def highlight_prefix(c: Text, prefix: str) -> Column:
    return F.concat(F.lit(f"<em>{prefix}</em>"), F.substring(col(c), F.lit(len(prefix) + 1), F.length(col(c))))


def category_slug(c: Text) -> Column:
    return F.concat(F.lit("/category/"), F.replace(F.lower(col(c)), F.lit(" "), F.lit("-")))


def logged_query(c: Text) -> Column:
    """A search as it is counted: lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"(?U)\s+", " "))


def clicked_query(c: Text) -> Column:
    """A click's query as it is counted: lower case, inner spaces as they are."""
    return F.trim(F.lower(col(c)))


def cache_key(query: Text, limit: int | Column, offset: int, sort: str, filters: str = "") -> Column:
    shown = limit.cast("string") if isinstance(limit, Column) else F.lit(str(limit))
    return F.md5(F.concat_ws("|", col(query), shown, F.lit(str(offset)), F.lit(sort), *([F.lit(filters)] if filters else [])))


def embedding_text() -> Column:
    """search_text if there is one, else name, brand, category and the description's first 500 characters."""
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("name", "brand", "category")]
    built = F.concat_ws(" ", *parts, F.nullif(F.substring("description", 1, 500), F.lit("")))
    return F.coalesce(F.nullif(F.col("search_text"), F.lit("")), built)


def rerank_text(fields: tuple[str, ...] = ("name", "brand", "category")) -> Column:
    return F.concat_ws(" | ", *(F.nullif(F.col(c), F.lit("")) for c in fields))


def money(c: Text, decimals: int = 2) -> Column:
    """``1 234,50``."""
    return F.translate(F.format_number(col(c), decimals), ",.", " ,")


def escape_html(c: Text) -> Column:
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def process(query: str = "q") -> list[Column]:
    """normalized, tokens, layout_variants and corrected of a column of queries."""
    n = normalize(query)
    return [n.alias("normalized"), tokenize(n).alias("tokens"), layout_variants(n).alias("layout_variants"), F.lit(False).alias("corrected")]
