"""Contacts, e-mail discovery, ranking, enrichment merge and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import dates, email, text
from leadloom.vocab import Settings

#: Evidence sources, best first.
SOURCE_RANK = ["COMPANY_WEBSITE", "JOB_BOARD", "ATS", "PUBLIC_DIRECTORY", "PUBLIC_WEB", "ZOOMINFO", "APOLLO", "APIFY"]


def source_rank(c: Column) -> Column:
    place = F.array_position(F.array(*map(F.lit, SOURCE_RANK)), c)
    return F.when(F.coalesce(place, F.lit(0)) == 0, F.lit(99)).otherwise(place)


def hiring_priority(titles: DataFrame, key: str = "company_id") -> DataFrame:
    """(key, hiring_priority): the most senior tier among titles(key, title)."""
    return titles.groupBy(key).agg(F.min(text.title_tier(F.col("title"))).alias("hiring_priority"))


def contact_confidence(method: Column, has_title: Column, tier: Column, has_email: Column) -> Column:
    """0 to 1, counted in hundredths: how a person was found, and what is known of them."""
    by_method = F.when(method == "STRUCTURED", 30).when(method.isin("MICROFORMAT", "TABLE"), 25).when(method.isin("BLOCK", "MAILTO"), 20).when(method == "TEXT", 10).otherwise(0)
    total = F.lit(30) + by_method + F.when(has_title, 20).otherwise(0) + F.when(tier.isNotNull(), 20).otherwise(0) + F.when(has_email, 10).otherwise(0)
    return F.least(total, F.lit(100)) / F.lit(100.0)


def contact_score(tier: Column, wanted: Column, confidence: Column, has_email: Column, stage: Column) -> Column:
    """Seniority, nearness to the tier that is hiring, confidence, an address, and how early the stage was."""
    near = F.when(wanted.isNull(), 0).when(tier == wanted, 10).when(F.abs(tier - wanted) == 1, 5).otherwise(0)
    return F.bround((5 - tier) * 20 + near + confidence * 8 + F.when(has_email, 4).otherwise(0) - 1.5 * stage, 2)


def select_contacts(contacts: DataFrame, limit: int = 6) -> DataFrame:
    """The best row of each name, then the best ``limit`` people of each company, by tier and rank_score."""
    tiered = contacts.withColumn("tier", text.title_tier(F.col("title"))).where("tier is not null and trim(coalesce(name, '')) <> ''")
    best = Window.partitionBy("company_id", F.lower(F.trim("name"))).orderBy(F.col("tier"), F.col("rank_score").desc_nulls_last(), F.col("ord"))
    order = Window.partitionBy("company_id").orderBy(F.col("tier"), F.col("rank_score").desc_nulls_last(), F.col("ord"))
    return tiered.withColumn("k", F.row_number().over(best)).where("k = 1").withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).drop("k")


def rank_pocs(contacts: DataFrame, domains: DataFrame) -> DataFrame:
    """contacts of POC tiers and poc_rank within their company: tier, address class, source, score, then order.

    domains(company_id, domain) may miss companies; their addresses are then external.
    """
    rows = contacts.join(domains.select("company_id", "domain"), "company_id", "left").withColumn("title_priority", text.title_tier(F.col("title")))
    rows = rows.where("title_priority is not null and trim(coalesce(name, '')) <> ''").withColumn("email_class", email.classify_email(F.col("email"), F.col("domain")))
    w = Window.partitionBy("company_id").orderBy("title_priority", -email.email_strength(F.col("email_class")), source_rank(F.col("source_type")), (-F.coalesce("rank_score", F.lit(0.0))), "ord")
    return rows.withColumn("poc_rank", F.row_number().over(w)).drop("domain")


def discover_emails(contacts: DataFrame, extras: DataFrame, domains: DataFrame) -> DataFrame:
    """Each company's addresses once, contacts before extras(company_id, ord, email); shared mailboxes lose their person."""
    people = contacts.select("company_id", F.lit(0).alias("part"), "ord", "email", "name", "title")
    others = extras.select("company_id", F.lit(1).alias("part"), "ord", "email", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("title"))
    rows = people.unionByName(others).withColumn("email", F.lower(F.trim("email"))).where(email.is_valid_email(F.col("email")))
    first = Window.partitionBy("company_id", "email").orderBy("part", "ord")
    rows = rows.withColumn("k", F.row_number().over(first)).where("k = 1").join(domains.select("company_id", "domain"), "company_id", "left")
    kind = email.classify_email(F.col("email"), F.col("domain"))
    rows = rows.withColumn("email_class", kind)
    person = lambda c: F.when(F.col("email_class") != "ROLE", F.col(c)).alias(c)
    on_domain = F.when(F.col("email_class").isin("PERSONAL", "ROLE"), True).when(F.col("email_class") == "DOMAIN_MISMATCH", False)
    out = rows.select("company_id", "email", "email_class", person("name"), person("title"), on_domain.alias("on_company_domain"), F.row_number().over(Window.partitionBy("company_id").orderBy("part", "ord")).alias("obs_ord"))
    return out.withColumn("confidence", email.email_confidence(F.col("email_class"), F.col("name").isNotNull()))


def email_status(observed: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """(company_id, counts by class, email_status), by the employer's own mailboxes first; companies may add some without any address."""
    n = lambda kind: F.count_if(F.col("email_class") == kind)
    kinds = ("PERSONAL", "ROLE", "DOMAIN_MISMATCH", "EXTERNAL_UNVERIFIED", "PORTAL_GENERATED")
    counts = [f"n_{k.lower()}" for k in kinds]
    rows = observed.groupBy("company_id").agg(*(n(k).alias(c) for k, c in zip(kinds, counts, strict=True)))
    if companies is not None:
        rows = companies.select("company_id").distinct().join(rows, "company_id", "left").fillna(0, counts)
    own = F.col("n_personal") + F.col("n_role")
    status = (
        F.when(own > 1, F.lit("MULTIPLE_EMAILS_FOUND")).when(F.col("n_personal") > 0, F.lit("PERSONAL_EMAIL_FOUND")).when(F.col("n_role") > 0, F.lit("ROLE_EMAIL_FOUND"))
        .when(sum((F.col(c) for c in counts[2:]), F.lit(0)) > 0, F.lit("LOW_CONFIDENCE_EMAIL_FOUND")).otherwise(F.lit("NO_PUBLIC_EMAIL_FOUND"))
    )
    return rows.withColumn("email_status", status)


def only_new(observed: DataFrame, known: DataFrame) -> DataFrame:
    """Addresses that the stored table does not have yet."""
    return observed.join(known.select("company_id", F.lower("email").alias("email")), ["company_id", "email"], "left_anti")


def match_people(contacts: DataFrame, provided: DataFrame) -> DataFrame:
    """provided and matched_ord: the first contact with the same address, provider id or person; three equi joins, no OR."""
    have = contacts.select("company_id", F.col("ord").alias("matched_ord"), F.lower("email").alias("e"), F.col("person_id").alias("p"), text.person_key(F.col("name")).alias("n"))
    want = provided.withColumn("e", F.lower("email")).withColumn("p", F.col("person_id")).withColumn("n", text.person_key(F.col("name")))
    hits = None
    for c in ("e", "p", "n"):
        one = want.where(f"{c} is not null").select("company_id", "seq", c).join(have.where(f"{c} is not null").select("company_id", "matched_ord", c), ["company_id", c]).select("company_id", "seq", "matched_ord")
        hits = one if hits is None else hits.unionByName(one)
    first = hits.groupBy("company_id", "seq").agg(F.min("matched_ord").alias("matched_ord"))
    return want.drop("e", "p", "n").join(first, ["company_id", "seq"], "left")


def merge_provider(contacts: DataFrame, provided: DataFrame, domains: DataFrame) -> DataFrame:
    """Contacts after one provider's answer: gaps filled, weaker addresses replaced, new people of POC tiers added.

    contacts(company_id, ord, name, title, email, person_id, origin), provided(company_id, seq, provider, name, title,
    email, person_id).  Of several matches for one contact the first fills; ``replaced_email`` keeps what gave way.
    """
    rows = match_people(contacts, provided).join(domains.select("company_id", "domain"), "company_id", "left")
    strength = lambda c: email.email_strength(email.classify_email(F.lower(c), F.col("domain")))
    w = Window.partitionBy("company_id", "matched_ord").orderBy("seq")
    fill = rows.where("matched_ord is not null").withColumn("k", F.row_number().over(w)).where("k = 1")
    fill = fill.select("company_id", F.col("matched_ord").alias("ord"), F.struct("name", "title", "email", "person_id", "provider").alias("f"), "domain")
    both = contacts.join(fill, ["company_id", "ord"], "left")
    stronger = F.coalesce(strength(F.col("f.email")) > strength(F.col("email")), F.lit(False))
    changed = F.col("f").isNotNull() & (stronger | (F.col("title").isNull() & F.col("f.title").isNotNull()))
    kept = both.select(
        "company_id", "ord", "name", F.coalesce("title", "f.title").alias("title"), F.when(stronger, F.lower("f.email")).otherwise(F.col("email")).alias("email"),
        F.coalesce("person_id", "f.person_id").alias("person_id"), F.when(changed, F.concat_ws("+", "origin", "f.provider")).otherwise(F.col("origin")).alias("origin"),
        F.when(stronger, F.col("email")).alias("replaced_email"),
    )
    fresh = rows.where("matched_ord is null").where(text.title_tier(F.col("title")).isNotNull())
    fresh = fresh.select("company_id", (F.lit(1_000_000) + F.col("seq")).alias("ord"), "name", "title", F.lower("email").alias("email"), "person_id", F.col("provider").alias("origin"), F.lit(None).cast("string").alias("replaced_email"))
    return kept.unionByName(fresh)


def budget_prefix(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows; a top-k the planner does without sorting everything."""
    return rows.orderBy(*order).limit(n)


def disable_for_run(attempts: DataFrame) -> DataFrame:
    """attempts and disabled: whether the provider was rate limited or unavailable earlier in the run.

    The first refusal of each provider is one aggregation, so a provider may hold any share of the attempts.
    """
    refused = attempts.where(F.col("status").isin(vocab.PROVIDER_STOPS)).groupBy("provider").agg(F.min("seq").alias("__refused"))
    return attempts.join(refused, "provider", "left").select(*attempts.columns, F.coalesce(F.col("seq") > F.col("__refused"), F.lit(False)).alias("disabled"))


def http_status_to_provider(code: Column, timed_out: Column) -> Column:
    return F.when(timed_out, F.lit("PROVIDER_TIMEOUT")).when(code == 429, F.lit("PROVIDER_RATE_LIMITED")).when(code.isin(401, 403), F.lit("PROVIDER_UNAVAILABLE")).when(code >= 400, F.lit("PROVIDER_ERROR")).otherwise(F.lit("SUCCESS"))


def verify(addresses: DataFrame, cache: DataFrame, recorded: DataFrame, now: Column, s: Settings = Settings(), configured: bool = True) -> DataFrame:
    """addresses(seq, company_id, email, email_class) and status, reason, verified_by, billable, in the run's order ``seq``.

    Classes other than PERSONAL and ROLE are SKIPPED.  An address whose newest row in cache(email, status, checked_at)
    is a verdict and young enough takes it.  The others are asked in order, each until it has an answer, up to the
    run's budget; recorded(email, code, timed_out, error, provider_status) holds the answers.  A refusal stops all
    later calls; whatever gets no verdict is PENDING with its reason.  A row without an address has nulls.
    """
    newest = cache.groupBy(F.lower("email").alias("e")).agg(F.max_by(F.struct("status", "checked_at"), "checked_at").alias("c"))
    given = recorded.groupBy(F.lower("email").alias("e")).agg(F.min(F.struct("code", "timed_out", "error", "provider_status")).alias("r"))
    rows = addresses.withColumn("e", F.nullif(F.lower(F.trim("email")), F.lit(""))).join(newest, "e", "left").join(given, "e", "left")
    rows = rows.withColumn("a", email.verifier_answer(F.col("r.code"), F.col("r.timed_out"), F.col("r.error"), F.col("r.provider_status")))
    trusted = F.coalesce(F.col("email_class").isin("PERSONAL", "ROLE"), F.lit(False))
    hit = F.coalesce(F.col("c.status").isin("VALID", "INVALID", "RISKY"), F.lit(False)) & dates.within_days(F.col("c.checked_at"), now, s.verification_refresh_days)
    rows = rows.withColumn("open", F.col("e").isNotNull() & trusted & ~hit)
    first = rows.where("open").groupBy("e").agg(F.min("seq").alias("first_seq"))
    rows = rows.join(first, "e", "left").withColumn("again", F.col("open") & ((F.col("seq") == F.col("first_seq")) | (F.col("a.status") == "PENDING")))
    stopping = F.col("a.reason").isin("PROVIDER_UNAVAILABLE", "PROVIDER_RATE_LIMITED")
    calls = rows.where("again").select("seq", "a.reason", stopping.alias("stops")).orderBy("seq").limit(s.verification_max_per_run)
    stop = calls.agg(F.max("seq").alias("last_seq"), F.min(F.when(F.col("stops"), F.struct("seq", "reason"))).alias("stop"))  # one row
    rows = rows.join(F.broadcast(stop))
    off = F.lit("DISABLED") if not s.verification_enabled else F.lit("NOT_CONFIGURED") if not configured else F.lit(None).cast("string")
    reached = lambda seq: F.coalesce((seq <= F.col("last_seq")) & (F.col("stop").isNull() | (seq <= F.col("stop.seq"))), F.lit(False))
    known = reached(F.col("first_seq")) & (F.col("a.status") != "PENDING")
    refused = F.coalesce(F.col("stop.reason"), F.lit("BUDGET_EXHAUSTED"))
    none, pending = F.lit(None).cast("string"), F.lit("PENDING")
    made = lambda status, reason, by, billable=F.lit(False): F.struct(status.alias("status"), reason.cast("string").alias("reason"), F.lit(by).cast("string").alias("verified_by"), billable.alias("billable"))  # noqa: E731, B008
    out = (
        F.when(F.col("e").isNull(), made(none, none, None))
        .when(~trusted, made(F.lit("SKIPPED"), F.concat(F.lit("EMAIL_CLASS:"), F.coalesce("email_class", F.lit("None"))), "CLASS"))
        .when(hit, made(F.col("c.status"), none, "CACHE"))
        .when(off.isNotNull(), made(pending, off, "NONE"))
        .when(known, made(F.col("a.status"), F.col("a.reason"), "PROVIDER", F.col("a.billable") & (F.col("seq") == F.col("first_seq"))))
        .when(F.col("again") & reached(F.col("seq")), made(pending, F.col("a.reason"), "PROVIDER"))
        .otherwise(made(pending, refused, "NONE"))
    )
    return rows.withColumn("o", out).select(*addresses.columns, "o.*")
