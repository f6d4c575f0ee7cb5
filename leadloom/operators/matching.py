"""Matching companies to directories, providers, profiles and domains.

Fuzzy matches are equi joins on telling words; scores and verdicts are expressions over the few rows that meet.
A wrong match is worse than none, so anything short of one clear candidate is AMBIGUOUS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import text, url
from leadloom.functions.location import us_state_of

LEAST_SIMILARITY = 0.75


def location_tokens(c: Column) -> Column:
    """Parts of a location, and name and code of every state that it names."""
    low = F.lower(F.coalesce(c, F.lit("")))
    parts = F.transform(F.split(low, r"[,/|]"), F.trim)
    states = F.flatten(F.array(*(F.when(low.contains(name) | low.rlike(rf"\b{code.lower()}\b"), F.array(F.lit(name), F.lit(code.lower()))).otherwise(F.array().cast("array<string>")) for name, code in vocab.US_STATES.items())))
    return F.array_distinct(F.filter(F.concat(parts, states), lambda t: F.length(t) >= 2))


def _told(rows: DataFrame, name: str) -> DataFrame:
    """(name, m, w): each telling word of each name, and all of them as one word, which is marked by a blank before it."""
    tokens = F.array_distinct(text.name_tokens(F.col(name)))
    joined = F.concat(F.lit(" "), F.array_join(text.name_tokens(F.col(name)), ""))
    return rows.select(name).distinct().select(name, F.size(tokens).alias("m"), F.explode(F.concat(tokens, F.array(joined))).alias("w"))


def _rare_first(words: DataFrame, often: DataFrame, name: str) -> DataFrame:
    """words and rare: so many of a name's rarest words that any name similar enough, if it has no fewer words, shares one of them."""
    place = F.row_number().over(Window.partitionBy(name).orderBy("often", "w"))  # a name's few words
    ranked = words.join(often, "w").withColumn("k", F.when(F.col("w").startswith(" "), F.lit(0)).otherwise(place))
    return ranked.select(name, "w", (F.col("k") <= F.floor(F.col("m") * 0.26) + 2).alias("rare"))


def match_directory(names: DataFrame, directory: DataFrame) -> DataFrame:
    """names(name, location) and status, url, matched_name, confidence, reason from directory(dir_name, slug, dir_url, dir_location).

    Candidates have a similarity of 0.75 or more; they are found by the rarest words of either name, so a word that
    many names hold pairs nobody by itself.  An exact slug settles it; then one candidate whose place agrees; two such, contradicting places, or a name alone are AMBIGUOUS.
    """
    asked = names.groupBy("name").agg(F.max("location").alias("location")).where("name <> ''")
    a, b = _told(asked, "name"), _told(directory.where("dir_url is not null").select("dir_name", "slug", "dir_url", "dir_location").distinct(), "dir_name")
    often = a.select("w").unionByName(b.select("w")).groupBy("w").agg(F.count("*").alias("often"))
    a, b = _rare_first(a, often, "name"), _rare_first(b, often, "dir_name")
    pairs = a.where("rare").select("name", "w").join(b.select("dir_name", "w"), "w").unionByName(a.select("name", "w").join(b.where("rare").select("dir_name", "w"), "w")).select("name", "dir_name").distinct()
    met = pairs.join(asked, "name").join(directory.where("dir_url is not null").select("dir_name", "slug", "dir_url", "dir_location").distinct(), "dir_name")
    met = met.withColumn("similarity", text.name_similarity(F.col("name"), F.col("dir_name"))).where(F.col("similarity") >= LEAST_SIMILARITY)
    where = F.trim(F.coalesce("dir_location", F.lit("")))
    met = met.withColumn("agrees", (where != "") & F.arrays_overlap(location_tokens(F.col("location")), location_tokens(F.col("dir_location")))).withColumn("placed", where != "")
    met = met.withColumn("exact", F.lower(F.trim("name")) == F.coalesce(F.lower(F.trim("slug")), F.lit("")))
    pick = lambda c: F.max(F.when(F.col(c), F.struct("dir_url", "dir_name")))
    seen = met.groupBy("name").agg(F.count("*").alias("n"), F.count_if("exact").alias("n_exact"), F.count_if("agrees").alias("n_agrees"), F.max("placed").alias("placed"), pick("exact").alias("by_slug"), pick("agrees").alias("by_place"))
    out = asked.join(seen, "name", "left")
    had = F.coalesce("location", F.lit("")) != ""
    status = F.when(F.coalesce("n", F.lit(0)) == 0, F.lit("NO_MATCH")).when((F.col("n_exact") == 1) | (F.col("n_agrees") == 1), F.lit("MATCHED")).otherwise(F.lit("AMBIGUOUS"))
    hit = F.when(F.col("n_exact") == 1, F.col("by_slug")).when(F.col("n_agrees") == 1, F.col("by_place"))
    reason = (
        F.when(F.coalesce("n", F.lit(0)) == 0, F.lit("NO_CANDIDATE")).when(F.col("n_exact") == 1, F.lit("SLUG")).when(F.col("n_agrees") == 1, F.lit("NAME_AND_LOCATION")).when(F.col("n_agrees") > 1, F.lit("SEVERAL_AGREE"))
        .when(had & F.col("placed"), F.lit("LOCATION_CONTRADICTS")).when(F.col("n") == 1, F.lit("NAME_ONLY")).otherwise(F.lit("SEVERAL_CANDIDATES"))
    )
    return out.select("name", status.alias("status"), hit["dir_url"].alias("url"), hit["dir_name"].alias("matched_name"), F.when(hit.isNotNull(), F.lit("HIGH")).alias("confidence"), reason.alias("reason"))


def attach_sites(postings: DataFrame, matches: DataFrame) -> DataFrame:
    """postings with the matched name, and the matched site where it is an employer's own."""
    m = matches.where("status = 'MATCHED'").select(F.col("name").alias("company_name"), F.col("url").alias("m_url"), F.col("matched_name"))
    out = postings.join(m, "company_name", "left")
    site = F.when(url.normalize_domain(F.col("m_url")) != "", F.col("m_url"))
    return out.select(*(c for c in postings.columns if c not in ("company_name", "company_website")), F.coalesce("matched_name", "company_name").alias("company_name"), F.coalesce("company_website", site).alias("company_website"), F.col("matched_name").isNotNull().alias("site_matched"))


def match_provider_company(companies: DataFrame, candidates: DataFrame) -> DataFrame:
    """companies(company_id, domain, name, states) and the one candidate(company_id, cand_id, cand_name, website, state) that it is, or why not."""
    root = lambda c: url.registrable_domain(url.extract_host(c))
    met = companies.join(candidates, "company_id", "left")
    on_domain = F.when(F.col("domain") != "", root(F.col("website")) == root(F.col("domain")))
    same = (text.normalize_company_name(F.col("cand_name")) == text.normalize_company_name(F.col("name"))) & ((F.size("states") == 0) | F.coalesce(F.array_contains("states", us_state_of(F.col("state"))), F.lit(False)))
    ids = lambda flag: F.collect_set(F.when(flag, F.col("cand_id")))
    found = met.groupBy("company_id").agg(F.max(F.coalesce(F.col("domain") != "", F.lit(False))).alias("has_domain"), F.max(F.size("states")).alias("n_states"), F.count("cand_id").alias("n"), ids(on_domain).alias("d"), ids(same).alias("s"))
    by_domain, by_name = F.col("has_domain") & (F.size("d") == 1), ~F.col("has_domain") & (F.size("s") == 1) & (F.col("n_states") > 0)
    reason = (
        F.when(F.col("n") == 0, F.lit("NO_MATCH")).when(by_domain | by_name, F.lit("MATCHED")).when(F.col("has_domain"), F.when(F.size("d") > 1, F.lit("AMBIGUOUS")).otherwise(F.lit("DOMAIN_MISMATCH")))
        .when((F.size("s") > 0) | (F.col("n") > 1), F.lit("AMBIGUOUS")).otherwise(F.lit("NO_MATCH"))
    )
    method = F.when(by_domain, F.lit("DOMAIN")).when(by_name, F.lit("NAME_AND_STATE"))
    return found.select("company_id", reason.alias("reason"), F.when(F.col("n") > 0, method).alias("method"), F.when(by_domain, F.get("d", F.lit(0))).when(by_name, F.get("s", F.lit(0))).alias("cand_id"))


def linkedin_identity(employers: DataFrame, items: DataFrame) -> DataFrame:
    """employers(company_id, domain) and identity of items(company_id, profile_company_url, company_website).

    Items are grouped by the company page they name, else by their website; exactly one group on the employer's
    domain is CONFIRMED, unless its items disagree.
    """
    root = url.registrable_domain(url.extract_host(F.col("company_website")))
    site = F.when((F.coalesce(root, F.lit("")) != "") & ~root.isin(vocab.PLATFORM_HOSTS), root)
    page = F.nullif(url.visit_key(F.nullif(F.trim("profile_company_url"), F.lit(""))), F.lit(""))
    rows = items.select("company_id", site.alias("site"), F.coalesce(page, site).alias("key")).where("key is not null")
    groups = rows.join(employers.select("company_id", url.registrable_domain(url.extract_host(F.col("domain"))).alias("employer")), "company_id")
    groups = groups.groupBy("company_id", "key").agg(F.max(F.col("site") == F.col("employer")).alias("on"), F.min(F.coalesce(F.col("site") == F.col("employer"), F.lit(True))).alias("only"), F.count("site").alias("sites"))
    by = groups.groupBy("company_id").agg(F.count_if(F.coalesce("on", F.lit(False))).alias("confirmed"), F.max(F.when(F.col("on"), F.col("only"))).alias("agree"), F.max(F.when(F.col("on"), F.col("key"))).alias("key"), F.sum("sites").alias("sites"))
    out = employers.join(by, "company_id", "left")
    status = (
        F.when((F.coalesce("domain", F.lit("")) == "") | F.col("confirmed").isNull(), F.lit("NO_COMPANY")).when(F.col("confirmed") > 1, F.lit("AMBIGUOUS"))
        .when(F.col("confirmed") == 1, F.when(F.col("agree"), F.lit("CONFIRMED")).otherwise(F.lit("AMBIGUOUS"))).when(F.col("sites") > 0, F.lit("DOMAIN_MISMATCH")).otherwise(F.lit("LINKEDIN_WEBSITE_MISSING"))
    )
    return out.select("company_id", status.alias("identity"), F.when(status == "CONFIRMED", F.col("key")).alias("company_key"))


def domain_confidence(affinity: Column, in_body: Column, in_title: Column, place: Column) -> Column:
    """HIGH, MEDIUM or LOW: the name must fit the domain, the page's wording and place corroborate."""
    either = in_body | in_title
    return (
        F.when((affinity >= 0.9) & either, F.when(place | in_body, F.lit("HIGH")).otherwise(F.lit("MEDIUM"))).when((affinity >= 0.5) & in_body & place, F.lit("HIGH"))
        .when((affinity >= 0.5) & either, F.lit("MEDIUM")).when(affinity >= 0.9, F.lit("MEDIUM")).when(in_body & place, F.lit("MEDIUM")).otherwise(F.lit("LOW"))
    )


def resolve_domains(candidates: DataFrame, limit: int = 4) -> DataFrame:
    """(company_id, domain, confidence, decision) from candidates(company_id, seq, name, location, domain, title, body).

    The first HIGH of the first ``limit`` candidates wins, else the best by confidence and affinity; only HIGH with
    any affinity is ACCEPTED, MEDIUM and a HIGH without affinity are for REVIEW.
    """
    rows = candidates.where(F.col("seq") <= limit).withColumn("affinity", text.name_domain_affinity(F.col("name"), F.col("domain")))
    words, low, head = text.name_tokens(F.col("name")), F.lower(F.coalesce("body", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))
    rows = rows.withColumn("w", words).withColumn("t", location_tokens(F.col("location")))
    in_body = (F.size("w") > 0) & F.forall("w", lambda w: low.contains(w))
    in_title, place = F.exists("w", lambda w: head.contains(w)), F.exists("t", lambda t: low.contains(t))
    rows = rows.withColumn("confidence", domain_confidence(F.col("affinity"), in_body, in_title, place))
    level = F.when(F.col("confidence") == "HIGH", 2).when(F.col("confidence") == "MEDIUM", 1).otherwise(0)
    order = F.struct(level.alias("a"), F.when(level == 2, F.lit(0.0)).otherwise(F.col("affinity")).alias("b"), (-F.col("seq")).alias("c"))
    best = rows.groupBy("company_id").agg(F.max_by(F.struct("domain", "confidence", "affinity"), order).alias("r")).select("company_id", "r.*")
    decision = F.when((F.col("confidence") == "HIGH") & (F.col("affinity") > 0), F.lit("ACCEPTED")).when(F.col("confidence") != "LOW", F.lit("REVIEW")).otherwise(F.lit("UNRESOLVED"))
    return best.withColumn("decision", decision)


def unwrap_redirect(c: Column) -> Column:
    """The target of a search engine's wrapped link; other links stay."""
    escaped = F.regexp_extract(c, r"[?&]uddg=([^&]+)", 1)
    coded = F.translate(F.regexp_extract(c, r"[?&]u=a1([A-Za-z0-9_\-]+)", 1), "-_", "+/")
    padded = F.rpad(coded, (F.ceil(F.length(coded) / 4) * 4).cast("int"), F.lit("="))
    return F.when(escaped != "", F.coalesce(F.try_url_decode(F.replace(escaped, F.lit("+"), F.lit("%2B"))), c)).when(coded != "", F.coalesce(F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8"), c)).otherwise(c)

