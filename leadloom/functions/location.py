"""US locations as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions.base import let
from leadloom.functions.text import SPACE

_STATES = [v for pair in vocab.US_STATES.items() for v in pair]


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " "))


def us_state_of(c: Column) -> Column:
    """The two-letter state a location names, or null; parts after the first are read right to left."""
    split = F.filter(F.transform(F.split(_squeeze(c), ","), lambda p: F.trim(F.regexp_replace(F.trim(p), r"^\.+|\.+$", ""))), lambda p: p != "")
    names = F.create_map(*map(F.lit, _STATES))

    def state(p: Column) -> Column:
        return F.when(F.lower(p).isin(vocab.COUNTRY_PARTS), F.lit(None)).when(F.upper(p).isin(vocab.STATE_CODES), F.upper(p)).otherwise(F.try_element_at(names, F.lower(p)))

    ordered = let(split, lambda parts: F.concat(F.reverse(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))), F.slice(parts, 1, 1)))
    return F.get(F.filter(F.transform(ordered, state), lambda s: s.isNotNull()), F.lit(0))


def normalize_country(c: Column) -> Column:
    value = F.lower(F.trim(c))
    return F.when(value.isin(vocab.COUNTRY_PARTS), F.lit("US")).when(value.rlike("^[a-z]{2}$"), F.upper(value))


def title_case(c: Column) -> Column:
    """Every letter after a non-letter in upper case, the others in lower case."""
    pieces = F.regexp_extract_all(c, F.lit(r"([\p{L}]+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(pieces, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")


def normalize_location(location: Column, country: Column, is_remote: Column) -> Column:
    """struct(city, state, country, remote, key)."""
    place = F.trim(F.regexp_replace(_squeeze(F.regexp_replace(F.coalesce(location, F.lit("")), r"\b\d{5}(?:-\d{4})?\b", "")), r"^[ ,]+|[ ,]+$", ""))
    abroad = "|".join(m.replace(".", r"\.") for m in vocab.NON_US_MARKERS)

    def read(p: Column) -> Column:
        text, state, first = p["text"], p["state"], p["first"]
        one_case = ((first == F.upper(first)) | (first == F.lower(first))) & first.rlike(r"\p{L}")
        city = F.when(state.isNotNull() & (first != "") & ~F.coalesce(us_state_of(first) == state, F.lit(False)) & ~F.lower(first).isin(vocab.COUNTRY_PARTS), F.when(one_case, title_case(first)).otherwise(first))
        low = F.lower(text)
        words = F.regexp_extract_all(F.replace(low, F.lit(".")), F.lit("[a-z]+"), 0)
        stated = F.when(state.isNotNull() | low.contains("united states") | F.arrays_overlap(words, F.array(F.lit("us"), F.lit("usa"))), F.lit("US")).when(low.rlike(abroad), F.lit("NON_US"))
        remote = F.coalesce(is_remote, F.lit(False)) | text.rlike(r"(?i)\bremote\b")
        return F.struct(city.alias("city"), state.alias("state"), F.coalesce(normalize_country(country), stated).alias("country"), remote.alias("remote"))

    def keyed(p: Column) -> Column:
        key = F.when(p["state"].isNotNull() & p["city"].isNotNull(), F.concat(p["city"], F.lit(", "), p["state"])).when(p["state"].isNotNull(), p["state"]).when(p["remote"], F.lit("remote")).otherwise(F.lit(""))
        return F.struct(*(p[c].alias(c) for c in ("city", "state", "country", "remote")), F.lower(key).alias("key"))

    first = lambda t: F.trim(F.regexp_replace(F.substring_index(t, ",", 1), r"(?i)^(?:hybrid|remote|on-?site|onsite)\s+(?:in|-)\s+", ""))
    parts = let(place, lambda t: F.struct(t.alias("text"), us_state_of(t).alias("state"), first(t).alias("first")))
    return let(let(parts, read), keyed)


def in_us_state(location: Column, state: Column) -> Column:
    """Whether a location names a state as an upper-case token or by its name; any location is in no state."""
    text = _squeeze(location)
    code = F.upper(state)
    names = F.create_map(*(F.lit(v) for c in vocab.STATE_CODES for v in (c, "|".join(n for n, s in vocab.US_STATES.items() if s == c))))
    token = F.regexp_like(text, F.concat(F.lit("(?<![A-Za-z])"), code, F.lit("(?![A-Za-z])")))
    named = F.regexp_like(text, F.concat(F.lit(r"(?i)\b(?:"), F.try_element_at(names, code), F.lit(r")\b")))
    return F.when(F.coalesce(state, F.lit("")) == "", F.lit(True)).when(text == "", F.lit(False)).otherwise(token | F.coalesce(named, F.lit(False)))
