"""Text and HTML functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Words between white space; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def sentences(text: Column) -> Column:
    """Pieces that end in . ! or ?, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def chunks(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Chunks of ``size`` words as structs (chunk_no, start_word, text, words).

    The overlap is applied at the first boundary only and later chunks follow
    each other without one, as in the workflow library this follows.
    """

    def cut(w: Column) -> Column:
        n = F.size(w)
        rest = F.when(n > size, F.sequence(F.lit(size - overlap), F.greatest(n - 1, F.lit(size - overlap)), F.lit(size))).otherwise(F.array().cast("array<int>"))
        starts = F.when(n > 0, F.concat(F.array(F.lit(0)), rest)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts,
            lambda s, i: F.struct(i.cast("int").alias("chunk_no"), s.cast("int").alias("start_word"), F.array_join(F.slice(w, s + 1, size), " ").alias("text"), F.least(n - s, F.lit(size)).cast("int").alias("words")),
        )

    # a lambda binds the words, so that a text is split once and not per chunk
    return F.element_at(F.transform(F.array(words(text)), cut), 1)


def first_and_last(text: Column, most: int = 300) -> Column:
    """First and last sentence, cut at ``most`` characters."""
    s = sentences(text)
    both = F.when(F.size(s) == 0, "").when(F.size(s) == 1, F.try_element_at(s, F.lit(1))).otherwise(F.concat_ws(" ", F.try_element_at(s, F.lit(1)), F.try_element_at(s, F.lit(-1))))
    return F.left(both, F.lit(most))


def key_phrases(text: Column, most: int = 5, longer_than: int = 5) -> Column:
    """First distinct lower-case words of more than ``longer_than`` letters."""
    plain = F.transform(words(text), lambda w: F.regexp_replace(F.lower(w), r"^[\p{Punct}]+|[\p{Punct}]+$", ""))
    return F.slice(F.array_distinct(F.filter(plain, lambda w: F.length(w) > longer_than)), 1, most)


def opening(text: Column, count: int = 3, longer_than: int = 20, most: int = 500) -> Column:
    """The first sentences of more than ``longer_than`` characters."""
    long = F.slice(F.filter(sentences(text), lambda s: F.length(s) > longer_than), 1, count)
    return F.left(F.array_join(long, " "), F.lit(most))


def best_category(text: Column, keywords: dict[str, list[str]], bonus: dict[str, Column] | None = None) -> Column:
    """Struct (category, score, confidence): the category with most of its
    keywords in the text, each counted once, plus bonus; the first one wins
    ties, and no hit gives "other" at 0.5."""
    low = F.lower(F.coalesce(text, F.lit("")))
    scored = []
    for name, listed in keywords.items():
        hits = sum((F.contains(low, F.lit(k)).cast("int") for k in listed), F.lit(0)) + (bonus or {}).get(name, F.lit(0))
        scored.append(F.struct(hits.cast("int").alias("score"), F.lit(-len(scored)).alias("order"), F.lit(name).alias("category")))

    def choose(all_scores: Column) -> Column:
        best, total = F.array_max(all_scores), F.aggregate(all_scores, F.lit(0), lambda s, x: s + x["score"])
        hit = best["score"] > 0
        return F.struct(
            F.when(hit, best["category"]).otherwise("other").alias("category"), best["score"].alias("score"), F.when(hit, F.round(best["score"] / total, 2)).otherwise(0.5).alias("confidence")
        )

    return F.element_at(F.transform(F.array(F.array(*scored)), choose), 1)


# Keywords of document categories.
DOCUMENT_KEYWORDS = {
    "legal": ["contract", "agreement", "clause", "party", "hereby", "law", "court"],
    "technical": ["api", "function", "system", "module", "algorithm", "code", "deploy"],
    "financial": ["revenue", "profit", "quarter", "fiscal", "budget", "investment"],
    "medical": ["patient", "diagnosis", "treatment", "clinical", "symptom", "dose"],
    "academic": ["research", "hypothesis", "methodology", "findings", "abstract"],
    "correspondence": ["dear", "regards", "sincerely", "meeting", "schedule"],
    "report": ["summary", "findings", "recommendations", "analysis", "overview"],
}
# Signals of page types in a page or its address, what a path may
# hold for a bonus, and the bonus.
PAGE_SIGNALS = {
    "homepage": ["welcome", "hero", "featured", "main-nav", "index"],
    "blog": ["article", "post", "author", "published", "blog", "date"],
    "landing": ["cta", "sign-up", "get-started", "pricing", "trial"],
    "product": ["price", "buy", "add-to-cart", "product", "features"],
    "docs": ["documentation", "api", "reference", "guide", "code", "syntax"],
    "about": ["about", "team", "mission", "story", "founded"],
    "contact": ["contact", "email", "phone", "address", "form"],
    "error": ["404", "not found", "error", "oops"],
}
PATH_SIGNALS = {"blog": ["blog", "post", "article"], "docs": ["doc", "api", "guide"], "about": ["about"], "contact": ["contact"], "product": ["product", "pricing"]}
PATH_BONUS = 3


def page_type(url: Column, html: Column) -> Column:
    """Struct (category, score, confidence) of a page: signals in its HTML or
    address, and a bonus for the first type that its path names."""
    path = F.trim(F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")), F.lit("/"))
    named = F.when(path.isin("", "index", "home"), "homepage")
    for name, parts in PATH_SIGNALS.items():
        named = named.when(F.greatest(*[F.contains(path, F.lit(p)) for p in parts], F.lit(False)), name)
    both = F.concat_ws("\n", F.lower(F.coalesce(html, F.lit(""))), F.lower(F.coalesce(url, F.lit(""))))
    return best_category(both, PAGE_SIGNALS, {name: F.when(F.coalesce(named == name, F.lit(False)), PATH_BONUS).otherwise(0) for name in PAGE_SIGNALS})


# ---- HTML -----------------------------------------------------------------


def strip_tags(html: Column) -> Column:
    """Text of a page: no scripts, styles or tags; entities and space folded."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    # The entities that are decoded.
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def page_metadata(html: Column) -> Column:
    """Struct of title, language, description, canonical, preview image and heading count."""
    def first(pattern: str) -> Column:
        return F.regexp_extract(html, pattern, 1)

    return F.struct(
        F.trim(first(r"(?is)<title[^>]*>(.*?)</title>")).alias("title"),
        first(r"(?is)<html[^>]*\blang=[\"']([^\"']*)").alias("lang"),
        first(r"(?is)<meta[^>]*name=[\"']description[\"'][^>]*content=[\"']([^\"']*)").alias("description"),
        first(r"(?is)<link[^>]*rel=[\"']canonical[\"'][^>]*href=[\"']([^\"']*)").alias("canonical"),
        first(r"(?is)<meta[^>]*property=[\"']og:image[\"'][^>]*content=[\"']([^\"']*)").alias("og_image"),
        F.size(F.regexp_extract_all(html, F.lit(r"(?is)<(h[1-3])[ >]"), 1)).alias("headings"),
    )


def links(html: Column) -> Column:
    """All href values, anchors and mail addresses included."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*\bhref=[\"']([^\"']*)[\"']"), 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
