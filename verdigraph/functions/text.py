"""Text functions of matching and search, as Column builders that stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_name(c: Column) -> Column:
    """Key of substance names: lower case, "in ground" suffixes, "/kg" and punctuation away."""
    c = squeeze(F.lower(c))
    for suffix in (r" in ground$", r", in ground$", r"/kg$"):
        c = F.regexp_replace(c, suffix, "")
    return squeeze(F.regexp_replace(c, "[,()'\"]", ""))


def link_key(c: Column) -> Column:
    """Key of product names in linking: one kind of dash and of space, trimmed, lower case."""
    dashes = "‐‑‒–—−"
    return F.lower(F.trim(F.translate(F.translate(c, dashes, "-" * len(dashes)), "  ", "  ")))


def _plain_letters() -> tuple[str, str]:
    """Composed letters of Latin, Greek, Cyrillic and their extensions, and what each is without its marks."""
    composed, plain = [], []
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            composed.append(chr(code))
            plain.append(base)
    return "".join(composed), "".join(plain)


_COMPOSED, _PLAIN = _plain_letters()


def search_text(c: Column) -> Column:
    """Lower case without accents, letters and digits only, words parted by one space."""
    plain = F.regexp_replace(F.translate(F.lower(c), _COMPOSED, _PLAIN), r"\p{M}+", "")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(search_text(c), " "), lambda w: w != "")


def trigrams(c: Column) -> Column:
    """Distinct runs of three characters; none for shorter words."""
    n = F.length(c)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: c.substr(i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets of trigrams; 0 when both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def coverage(query: Column, candidate: Column) -> Column:
    """Share of the query's trigrams that the candidate has."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, candidate)) / F.size(query)).otherwise(F.lit(0.0))


def cas_first(c: Column) -> Column:
    """CAS number of three parts without the leading zeros of its first."""
    part = F.split(F.trim(c), "-")
    stripped = F.regexp_replace(part[0], "^0+", "")
    return F.when(F.size(part) == 3, F.concat_ws("-", stripped, part[1], part[2])).otherwise(F.trim(c))


def cas_every(c: Column) -> Column:
    """CAS number without the leading zeros of any part; null if all are zeros."""
    parts = F.transform(F.split(F.trim(c), "-"), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.when(F.exists(parts, lambda p: p != ""), F.array_join(F.transform(parts, lambda p: F.when(p == "", "0").otherwise(p)), "-"))


def medium(c: Column) -> Column:
    """air, water, soil or other, by what the category says first."""
    low = F.lower(c)
    return (
        F.when(low.contains("air"), "air")
        .when(low.contains("water") | low.contains("aquatic"), "water")
        .when(low.contains("soil") | low.contains("ground"), "soil")
        .otherwise("other")
    )


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9_-]+", "-"), "^-+|-+$", "")


def name_prefix(c: Column) -> Column:
    """What stands before the first comma, brace or parenthesis."""
    return F.trim(F.regexp_extract(c, r"^[^,{(]*", 0))


def bracketed_location(c: Column) -> Column:
    """The code in {XX}, else in [XX] of two or three characters that begin with a capital, else empty."""
    braces, square = F.regexp_extract(c, r"\{([^}]*)\}", 1), F.regexp_extract(c, r"\[([A-Z][^\]]{1,2})\]", 1)
    return F.when(braces != "", braces).otherwise(square)


def product_prefixes(c: Column) -> Column:
    """Shorter names to look up for a compound one, in order: cut at //, " {", " [", " |", then without (TAG), then without "/LOC U"."""

    def cut(mark: str) -> Column:
        return F.when(F.instr(c, mark) > 0, F.trim(F.substring_index(c, mark, 1)))

    untagged = F.regexp_replace(c, r"\s*\([A-Z][A-Z0-9 ._-]*\)\s*$", "")
    placeless = F.regexp_replace(c, r"\s*/[A-Z][A-Za-z-]*( [US])?\s*$", "")
    bare = F.regexp_replace(placeless, r"\s*\([A-Z][A-Z0-9 ._-]*\)\s*$", "")
    more = [F.when(x != c, x) for x in (untagged, placeless, bare)]
    return F.array_distinct(F.filter(F.array_compact(F.array(*[cut(m) for m in ("//", " {", " [", " |")], *more)), lambda p: p != ""))


def contains_words(fields: list[Column], query: Column) -> Column:
    """Every word of the query is part of one of the fields at least."""
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != "")

    def found(w: Column) -> Column:
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.contains(F.lower(f), w), F.lit(False))
        return hit

    return F.forall(words, found)


def escape_csv(c: Column) -> Column:
    """Quoted when it holds a semicolon, a quote or a line end."""
    return F.when(c.rlike('[;"\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def uuid5(namespace: str, c: Column) -> Column:
    """Name-based UUID of version 5 in the namespace (a UUID's text)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), c.cast("binary")))
    variant = F.lower(F.hex(F.conv(h.substr(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), F.concat(F.lit("5"), h.substr(14, 3)), F.concat(variant, h.substr(18, 3)), h.substr(21, 12))
