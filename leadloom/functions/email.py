"""E-mail addresses as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions.text import unescape
from leadloom.functions.url import extract_host, registrable_domain

ADDRESS = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
_IMAGE = r"\.(?:png|jpg|jpeg|gif|webp|svg)$"
_ESCAPED = r"\\([\\`*_{}\[\]()#+\-.!])"


def decoded(text: Column) -> Column:
    """Entities, percent codes and Markdown's backslashes undone, in this order; a plus sign stays one."""
    plain = unescape(F.replace(F.replace(text, F.lit("&#64;"), F.lit("@")), F.lit("&#46;"), F.lit(".")))
    coded = F.replace(F.regexp_replace(plain, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    plain = F.when(plain.rlike("%[0-9A-Fa-f]{2}"), F.coalesce(F.try_url_decode(coded), plain)).otherwise(plain)
    return F.when(plain.contains("\\"), F.regexp_replace(plain, _ESCAPED, "$1")).otherwise(plain)


def extract_emails(text: Column) -> Column:
    """Distinct addresses of a text in order, lower-cased, without file names of images and cut-off mailboxes; null has none."""
    found = F.regexp_extract_all(decoded(text), F.lit(f"({ADDRESS})"), 1)
    tidy = F.transform(found, lambda e: F.regexp_replace(F.lower(e), r"[.,;:)]+$", ""))
    kept = F.array_distinct(F.filter(tidy, lambda e: ~e.rlike(_IMAGE) & e.rlike(r"^(?:[a-z0-9]|[a-z0-9][^@]*[a-z0-9])@")))
    return F.when(text.rlike("@|%40|&#64;|&commat;"), kept).otherwise(F.array().cast("array<string>"))


def is_role_email(email: Column) -> Column:
    local = F.lower(F.trim(F.substring_index(email, "@", 1)))
    return F.coalesce(email.contains("@") & (local.isin(vocab.ROLE_LOCALS) | local.rlike("|".join(vocab.ROLE_TOKENS))), F.lit(False))


def is_valid_email(email: Column) -> Column:
    domain = F.lower(F.substring_index(email, "@", -1))
    shape = email.rlike(f"^{ADDRESS}$") & ~email.rlike("%[0-9a-fA-F]{2}") & email.rlike(r"^(?:[A-Za-z0-9]|[A-Za-z0-9][^@]*[A-Za-z0-9])@")
    return F.coalesce(shape & ~domain.isin(vocab.JUNK_MAIL_DOMAINS) & ~domain.rlike(_IMAGE), F.lit(False))


def classify_email(email: Column, company_domain: Column) -> Column:
    """PORTAL_GENERATED, EXTERNAL_UNVERIFIED, DOMAIN_MISMATCH, ROLE or PERSONAL; null for null."""
    host = F.lower(F.substring_index(email, "@", -1))
    root, company = registrable_domain(host), registrable_domain(extract_host(company_domain))
    return (
        F.when(email.isNull(), F.lit(None))
        .when(root.isin(vocab.PLATFORM_HOSTS) | host.rlike("|".join(vocab.ATS_TOKENS)), F.lit("PORTAL_GENERATED"))
        .when(root.isin(vocab.FREE_MAIL) | (company == ""), F.lit("EXTERNAL_UNVERIFIED"))
        .when(root != company, F.lit("DOMAIN_MISMATCH"))
        .when(is_role_email(email), F.lit("ROLE"))
        .otherwise(F.lit("PERSONAL"))
    )


def email_strength(kind: Column) -> Column:
    """4 for PERSONAL down to 0 for PORTAL_GENERATED; -1 without an address."""
    return F.when(kind == "PERSONAL", 4).when(kind == "ROLE", 3).when(kind == "DOMAIN_MISMATCH", 2).when(kind == "EXTERNAL_UNVERIFIED", 1).when(kind == "PORTAL_GENERATED", 0).otherwise(-1)


def email_confidence(kind: Column, named: Column) -> Column:
    return F.when(kind == "PERSONAL", F.when(named, 0.9).otherwise(0.6)).when(kind == "ROLE", 0.7).when(kind == "DOMAIN_MISMATCH", 0.3).when(kind == "EXTERNAL_UNVERIFIED", 0.2).when(kind == "PORTAL_GENERATED", 0.1)


#: A provider's answer and what it means; anything else is UNKNOWN.
PROVIDER_STATUS = {"valid": "VALID", "invalid": "INVALID", "catch-all": "RISKY", "spamtrap": "RISKY", "abuse": "RISKY", "do_not_mail": "RISKY", "unknown": "UNKNOWN"}


def provider_status(c: Column) -> Column:
    known = F.create_map(*(F.lit(v) for pair in PROVIDER_STATUS.items() for v in pair))
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(c))), F.lit("UNKNOWN"))


def verifier_answer(code: Column, timed_out: Column, error: Column, said: Column) -> Column:
    """struct(status, reason, billable) of a verifier's recorded answer; whatever isn't a verdict leaves the address PENDING.

    code is the HTTP status, error the message of a failure in the body, said the provider's own word.
    """
    made = lambda status, reason, billable=False: F.struct(status.alias("status"), reason.cast("string").alias("reason"), F.lit(billable).alias("billable"))
    pending = lambda reason: made(F.lit("PENDING"), reason)
    known = F.create_map(*(F.lit(v) for pair in PROVIDER_STATUS.items() for v in pair))
    word = F.lower(F.coalesce(said, F.lit("")))
    verdict = F.try_element_at(known, word)
    return (
        F.when(F.coalesce(timed_out, F.lit(False)), pending(F.lit("PROVIDER_TIMEOUT")))
        .when(code.isin(401, 403), pending(F.lit("PROVIDER_UNAVAILABLE")))
        .when(code == 429, pending(F.lit("PROVIDER_RATE_LIMITED")))
        .when(F.coalesce(code, F.lit(0)) == 0, pending(F.lit("PROVIDER_ERROR:NO_ANSWER")))
        .when(code >= 400, pending(F.lit("PROVIDER_ERROR:HTTP_STATUS")))
        .when(F.coalesce(error, F.lit("")) != "", pending(F.lit("PROVIDER_UNAVAILABLE")))
        .when(verdict.isNull(), pending(F.concat(F.lit("UNRECOGNIZED_STATUS:"), word)))
        .when(verdict == "UNKNOWN", made(verdict, F.lit(None)))
        .otherwise(made(verdict, F.lit(None), True))
    )
