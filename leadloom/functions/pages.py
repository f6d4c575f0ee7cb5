"""Page addresses as Column expressions: what kind of page a URL names, whether it may be fetched, and where it comes from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions.base import let
from leadloom.functions.text import person_key


def segments(url: Column) -> Column:
    """Lower-case parts of a URL's path."""
    path = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def is_listing_page(url: Column) -> Column:
    """A blog post, news item, job or tag listing, or a sitemap."""
    return F.exists(segments(url), lambda s: s.isin(vocab.NON_PEOPLE_SEGMENTS) | s.endswith(".xml"))


def is_people_page(url: Column) -> Column:
    """A team, leadership, about or management page, and not the homepage."""
    spoken = lambda s: F.arrays_overlap(F.split(s, "[-_.]"), F.array(*map(F.lit, vocab.PEOPLE_PAGE_WORDS))) | s.contains("who-we-are")
    return F.exists(segments(url), spoken) & ~is_listing_page(url)


def names_contacts(url: Column) -> Column:
    """Whether a URL says that it leads to people or ways to reach them."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return F.exists(F.array(*map(F.lit, vocab.CONTACT_PATH_TOKENS)), lambda t: F.contains(low, t)) & ~is_listing_page(url)


def _authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def source_of_url(url: Column) -> Column:
    """struct(source_type, source_priority) of whoever publishes a page."""
    host = _authority(url)
    made = lambda kind, rank: F.struct(F.lit(kind).alias("source_type"), F.lit(rank).alias("source_priority"))
    on = lambda hosts: F.exists(F.array(*map(F.lit, hosts)), lambda h: F.contains(host, h))
    return F.when(on(vocab.BOARD_HOSTS), made("JOB_BOARD", 2)).when(on(vocab.ATS_HOSTS), made("ATS", 1)).otherwise(made("COMPANY_WEBSITE", 3))


#: Blocks of IPv4 addresses that are not of the public network, as first and last 32-bit values.
_RESERVED = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 3),
]


def _ipv4(host: Column) -> Column:
    """An IPv4 literal as a number, else null."""
    parts = F.transform(F.split(host, r"\."), lambda p: p.try_cast("long"))
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda total, p: total * 256 + p)
    return F.when(host.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.|$)){4}$"), value)


def url_refused(url: Column) -> Column:
    """Why a URL must not be fetched, or null: scheme, credentials, no host, internal names and addresses outside the public network.

    Names are judged by themselves; what they resolve to is the fetcher's business.  IPv6 literals are refused
    unless they are of the global unicast range.
    """
    text = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    place = _authority(url)
    bare = F.substring_index(place, "@", -1)
    literal = F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)
    host = F.regexp_replace(F.regexp_extract(bare, "^([^:]*)", 1), r"\.$", "")

    def judged(p: Column) -> Column:
        number = _ipv4(p["host"])
        bounds = [(sum(int(b) << 8 * (3 - i) for i, b in enumerate(net.split("."))), bits) for net, bits in _RESERVED]
        inner = None
        for low, bits in bounds:
            here = number.between(F.lit(low).cast("long"), F.lit(low + (1 << 32 - bits) - 1).cast("long"))
            inner = here if inner is None else inner | here
        internal = p["host"].isin(vocab.BLOCKED_HOSTS) | p["host"].rlike("(?:" + "|".join(s.replace(".", r"\.") for s in vocab.BLOCKED_SUFFIXES) + ")$")
        return (
            F.when(p["text"] == "", F.lit("EMPTY")).when(~p["scheme"].isin("http", "https"), F.lit("SCHEME")).when(p["place"].contains("@"), F.lit("CREDENTIALS"))
            .when(p["six"] != "", F.when(p["six"].rlike("^[23][0-9a-f]{0,3}:"), F.lit(None)).otherwise(F.lit("NON_PUBLIC_ADDRESS")))
            .when(p["host"] == "", F.lit("NO_HOST")).when(internal, F.lit("INTERNAL_HOST")).when(F.coalesce(inner, F.lit(False)), F.lit("NON_PUBLIC_ADDRESS"))
        )

    return let(F.struct(text.alias("text"), scheme.alias("scheme"), place.alias("place"), literal.alias("six"), host.alias("host")), judged)


def is_safe_url(url: Column) -> Column:
    return url_refused(url).isNull()


def subdomain_rank(host: Column, domain: Column) -> Column:
    """0 for subdomains that usually hold people or jobs, 1 for those that may, null for all others."""
    label = F.when(F.endswith(host, F.concat(F.lit("."), domain)), F.substring_index(F.substr(host, F.lit(1), F.length(host) - F.length(domain) - 1), ".", 1))
    return F.when(label.isin(vocab.SUBDOMAIN_FIRST), 0).when(label.isin(vocab.SUBDOMAIN_SECOND), 1)


def epoch_millis(c: Column) -> Column:
    """The time of a count of milliseconds, given as a number or text; null where it is neither."""
    return F.timestamp_millis(c.cast("string").try_cast("long"))


def month_day(c: Column, now: Column) -> Column:
    """The date of a stamp without a year, such as ``Sep 12``: this year's, or last year's where that lies more than a day ahead."""
    names = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    text = F.lower(c)
    pattern = r"\b(" + "|".join(names) + r")[a-z]*\.?\s+(\d{1,2})\b"
    month = F.array_position(F.array(*map(F.lit, names)), F.regexp_extract(text, pattern, 1)).cast("int")
    day = F.regexp_extract(text, pattern, 2).try_cast("int")
    in_year = lambda y: F.try_make_timestamp(y, month, day, F.lit(0), F.lit(0), F.lit(0))
    this, last = in_year(F.year(now)), in_year(F.year(now) - 1)
    near = F.unix_micros(this) - F.unix_micros(now) < 2 * 86_400_000_000
    return F.when(near, this).when(this.isNotNull(), last)


def clean_text(c: Column, limit: int = 160) -> Column:
    """Blanks collapsed, dashes and bars at the ends dropped, cut to a length; null for nothing."""
    text = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.nullif(F.substring(F.regexp_replace(text, r"^[  \-–—,·|]+|[  \-–—,·|]+$", ""), 1, limit), F.lit(""))


def obfuscated_same(first: Column, last: Column, name: Column) -> Column:
    """Whether a person whose last name is masked (``Hu***n``) may be the one named: first names are equal and what shows of the last one fits."""
    key, shown = person_key(name), F.lower(F.coalesce(last, F.lit("")))
    surname = F.substring_index(key, " ", -1)
    fits = surname.startswith(F.substring_index(shown, "*", 1)) & surname.endswith(F.substring_index(shown, "*", -1))
    return F.coalesce(shown.contains("*") & (F.lower(first) != "") & (F.substring_index(key, " ", 1) == F.lower(first)) & fits, F.lit(False))
