"""Names, titles and phrases as Column expressions."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leadloom import vocab
from leadloom.functions.base import let

SPACE = r"(?U)\s+"
_TAIL = r"(?U)[\s,.\-–—/|]+$"


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Latin letters whose compatibility decomposition is one ASCII letter and marks, and those letters."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x1F00) if (d := unicodedata.normalize("NFKD", chr(c))) and d[0].isascii() and d[0].isalpha() and all(map(unicodedata.combining, d[1:]))]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def normalize_text(c: Column) -> Column:
    """Lower case, blanks collapsed and trimmed; null gives ''."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(c), SPACE, " ")), F.lit(""))


#: Entities decoded inside the JVM; ``fold_exact`` knows all of them.
ENTITIES = {"&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&#039;": "'", "&apos;": "'", "&rsquo;": "’", "&lsquo;": "‘", "&ndash;": "–", "&mdash;": "—", "&lt;": "<", "&gt;": ">", "&eacute;": "é", "&amp;": "&"}


def unescape(c: Column) -> Column:
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def fold(c: Column) -> Column:
    """Common entities decoded, accents of Latin letters and combining marks removed, without leaving the JVM."""
    accented, plain = _accents()
    return F.regexp_replace(F.translate(unescape(c), accented, plain), r"\p{M}+", "")


@F.pandas_udf(StringType())
def fold_exact(texts):  # pragma: no cover - runs in workers
    """Every entity and every compatibility form; an Arrow UDF for text beyond Latin letters."""

    def one(value):
        decomposed = unicodedata.normalize("NFKD", html.unescape(value))
        return "".join(ch for ch in decomposed if not unicodedata.combining(ch))

    return texts.map(one, na_action="ignore").astype(object)


def normalize_title(c: Column, exact: bool = False) -> Column:
    """Formatting made uniform; wording stays."""
    folded = fold_exact(c) if exact else fold(c)
    return F.regexp_replace(normalize_text(F.regexp_replace(folded, "[‐-―]", "-")), _TAIL, "")


def normalize_company_name(c: Column, exact: bool = False) -> Column:
    """Accents, apostrophes, punctuation, up to three legal forms at the end and a leading ``the`` are removed."""
    folded = fold_exact(c) if exact else fold(c)
    name = F.regexp_replace(normalize_text(F.replace(folded, F.lit("&"), F.lit(" and "))), "['’`]", "")
    name = F.regexp_replace(name, _TAIL, "")
    legal = r"(?U)[\s,]*\b(?:" + "|".join(map(re.escape, vocab.LEGAL_SUFFIXES)) + r")\b\.?$"
    for _ in range(3):
        name = F.regexp_replace(F.regexp_replace(name, legal, ""), _TAIL, "")
    name = F.trim(F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\s]", " "), SPACE, " "))
    return F.regexp_replace(name, r"^the\s+", "")


def phrase_pattern(phrases: list[str]) -> str:
    """Whole words, any case, longest phrase first, with an optional plural s."""
    return r"(?i)\b(?:" + "|".join(re.escape(p) for p in sorted(phrases, key=len, reverse=True)) + r")s?\b"


def has_phrase(c: Column, phrases: list[str]) -> Column:
    return F.coalesce(c.rlike(phrase_pattern(phrases)), F.lit(False))


def first_phrase(c: Column, phrases: list[str]) -> Column:
    """The first phrase found, lower-cased, or null."""
    return F.nullif(F.lower(F.regexp_extract(c, phrase_pattern(phrases), 0)), F.lit(""))


def all_phrases(c: Column, phrases: list[str]) -> Column:
    """Distinct phrases in order of first appearance, lower-cased."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(phrase_pattern(phrases)), 0)
    return F.array_distinct(F.transform(found, F.lower))


def contact_title(c: Column) -> Column:
    """A title in the form of the tier lists."""
    text = F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))
    return F.regexp_replace(text, r"\b(?:vice president|svp|evp)\b", "vp")


def title_tier(c: Column) -> Column:
    """1 to 4 for titles that decide on hiring, else null; the most senior tier named wins."""
    words = lambda phrases: r"\b(?:" + "|".join(map(re.escape, phrases)) + r")\b"
    text = contact_title(c)
    tier = F.when(text.rlike(words(vocab.TITLE_EXCLUSIONS)), F.lit(None).cast("int"))
    for n, phrases in vocab.TITLE_TIERS.items():
        where = F.regexp_replace(text, vocab.QUALIFIED_PRESIDENT, " ") if n == 1 else text
        tier = tier.when(where.rlike(words(phrases)), F.lit(n))
    return tier


def person_key(c: Column) -> Column:
    """'first last' of a person's name, or null with fewer than two words."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]+"), 0), lambda w: (F.length(w) > 1) & ~w.isin("jr", "sr", "ii", "iii", "iv", "phd", "mba"))
    return F.when(F.size(words) >= 2, F.concat_ws(" ", F.element_at(words, 1), F.element_at(words, -1)))


def name_tokens(c: Column) -> Column:
    """Telling words of a company name: longer than two letters and not a usual business word."""
    return F.filter(F.split(normalize_company_name(c), " "), lambda w: (F.length(w) > 2) & ~w.isin(vocab.NAME_NOISE))


def name_similarity(a: Column, b: Column) -> Column:
    """Share of telling words in common over the shorter name, to two places; 1 where the names differ only in blanks."""

    def compare(p: Column) -> Column:
        x, y = p["x"], p["y"]
        shared = F.size(F.array_intersect(x, y)) / F.least(F.size(F.array_distinct(x)), F.size(F.array_distinct(y)))
        empty = (F.size(x) == 0) | (F.size(y) == 0)
        return F.when(empty, F.lit(0.0)).when(F.array_join(x, "") == F.array_join(y, ""), F.lit(1.0)).otherwise(F.bround(shared, 2))

    return let(F.struct(name_tokens(a).alias("x"), name_tokens(b).alias("y")), compare)


def name_domain_affinity(name: Column, root: Column) -> Column:
    """How much of a company name a domain's label accounts for: 1 equal, 0.9 a prefix either way, else the share of words in it, 0.7 for initials."""

    def compare(p: Column) -> Column:
        label, words = p["label"], p["words"]
        joined = F.array_join(words, "")
        inside = F.bround(F.size(F.filter(words, lambda w: label.contains(w))) / F.size(words), 2)
        initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
        return (
            F.when((label == "") | (F.size(words) == 0), F.lit(0.0))
            .when(label == joined, F.lit(1.0))
            .when(joined.startswith(label) | label.startswith(joined), F.lit(0.9))
            .when((inside == 0) & (F.size(words) >= 2) & (label == initials), F.lit(0.7))
            .otherwise(inside)
        )

    label = F.regexp_replace(F.lower(F.substring_index(root, ".", 1)), "[^a-z0-9]", "")
    return let(F.struct(label.alias("label"), name_tokens(name).alias("words")), compare)
