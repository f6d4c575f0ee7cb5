"""Enrichment of qualified companies: providers in order, each asked only for what is still missing.

A provider's recorded answers are tables; what a run would have asked, in which order and up to which budget, is worked
out from them.  The steps are unrolled, one after the other, as each provider's need depends on what the one before
has filled.  Inside a company, of which a handful of people are kept, answers are merged in their order by one Python
function; companies never meet there.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import dates, email, text
from leadloom.operators.people import source_rank
from leadloom.scratch import Scratch
from leadloom.vocab import Settings

CONTACT = "company_id string, ord long, contact_id string, name string, title string, title_priority int, email string, profile_url string, rank_score double, source_type string, origin string"
PROVIDED = "company_id string, provider string, seq long, name string, title string, email string, profile_url string, person_id string, extraction_method string, evidence_url string"
OUTCOMES = "company_id string, provider string, status string, reason string, match_method string, provider_company_id string, requests int, credits double, billable boolean, call_stop string"
ATTEMPT = (
    "company_id string, step int, provider string, called boolean, status string, reason string, fallback_reason string, need_full boolean, need_people array<string>, match_method string, "
    "provider_company_id string, fields_supplied array<string>, contacts_added int, contacts_upgraded int, requests int, billable boolean, credits double"
)
_FIELD = "map<string,struct<provider:string,value:string,evidence_url:string>>"
_MERGED = f"contacts array<struct<ord:long,contact_id:string,name:string,title:string,title_priority:int,email:string,profile_url:string,rank_score:double,source_type:string,origin:string,replaced_email:string,fields:{_FIELD}>>, status string, reason string, added int, upgraded int, supplied array<string>, emails array<struct<email:string,name:string,title:string,evidence_url:string>>"


@dataclass(frozen=True)
class Provider:
    name: str
    max_companies: int = 25
    refresh_days: int | None = 90
    configured: bool = True


def has_personal(c: Column, domain: Column) -> Column:
    return F.coalesce(email.classify_email(F.lower(c), domain) == "PERSONAL", F.lit(False))


def decide(first: bool, previous: Column, provider: Column, reason: Column, below_target: Column, missing: Column) -> Column:
    """struct(need, reason): what the next provider is asked for (``full``, ``people`` or null) and why, by what the one before it did.

    previous, provider and reason are of the last provider that was consulted, null where none was; missing are the
    names of the leading people without a personal address.
    """
    made = lambda need, why: F.struct(F.lit(need).cast("string").alias("need"), why.cast("string").alias("reason"))
    done = made(None, F.lit("NOTHING_MISSING"))
    if first:
        return F.when(below_target, made("full", F.lit("PRIMARY"))).otherwise(done)
    said = F.concat_ws(" ", provider, previous)
    names = F.array_join(F.transform(missing, lambda n: F.coalesce(n, F.lit("?"))), ", ")
    detail = F.when(F.coalesce(reason, F.lit("")) != "", F.concat(F.lit(": "), reason)).otherwise(F.lit(""))
    return (
        F.when(previous == "PROVIDER_SUCCESS", made(None, said))
        .when((previous == "PROVIDER_PARTIAL") & (F.size(missing) > 0), made("people", F.concat(said, F.lit(": no PERSONAL email for "), names)))
        .when(previous.isin(vocab.PROVIDER_FAILURES) & below_target, made("full", F.concat(said, detail)))
        .otherwise(done)
    )


def _merge(have: pd.DataFrame, found: pd.DataFrame, step: dict, target: int, limit: int) -> dict:
    """One company's people after one provider's answer.

    The same person is one contact: by address, by the provider's own id, or by first and last name, the first that fits.
    A gap is filled and an address replaced only by a stronger one; new people count only with a title of the tiers.
    A provider that was asked about somebody, or touched somebody, and leaves that person without a personal address
    has answered in part.
    """
    provider, people = step["provider"], [dict(r, fields={}, replaced_email=None, ids={}) for r in have.to_dict("records")]
    touched, added, upgraded, emails = set(), 0, 0, []
    for r in found.to_dict("records"):
        source = lambda field, r=r: {"provider": provider, "value": r[field], "evidence_url": r["evidence_url"]}
        same = lambda c, r=r: (c["email"] and r["email"] and c["email"].lower() == r["email"].lower()) or (r["person_id"] is not None and c["ids"].get(provider) == r["person_id"]) or (c["key"] is not None and c["key"] == r["key"])
        match = next((i for i, c in enumerate(people) if same(c)), None)
        if match is None:
            if r["tier"] is None:
                continue
            match = len(people)
            new = {k: r[k] for k in ("name", "title", "email", "profile_url", "key", "strength", "personal")}
            people.append(new | {"ord": step["first_ord"] + r["seq"], "contact_id": None, "title_priority": r["tier"], "rank_score": None, "source_type": provider, "origin": provider, "rank": step["rank"], "replaced_email": None, "ids": {}, "fields": {f: source(f) for f in ("name", "title", "email", "profile_url") if r[f]}})
            added += 1
        else:
            c, better = people[match], False
            if provider not in (c["origin"] or "").split("+"):
                c["origin"] = "+".join(filter(None, [c["origin"], provider]))
            if r["email"] and r["strength"] > c["strength"]:
                c["replaced_email"] = c["email"] or c["replaced_email"]
                c.update(email=r["email"], strength=r["strength"], personal=r["personal"])
                c["fields"]["email"], better = source("email"), True
            if r["profile_url"] and not c["profile_url"]:
                c["profile_url"] = r["profile_url"]
                c["fields"]["profile_url"], better = source("profile_url"), True
            upgraded += better
        people[match]["ids"][provider] = r["person_id"]
        touched.add(match)
        if r["email"]:
            emails.append({k: r[k] for k in ("email", "name", "title", "evidence_url")})
    order = sorted(range(len(people)), key=lambda i: (people[i]["title_priority"] or 9, -people[i]["strength"], people[i]["rank"], -(people[i]["rank_score"] or 0), i))[:limit]
    status, reason = step["status"], step["reason"]
    open_ = [i for i in [i for i in order if people[i]["title_priority"]][:target] if not people[i]["personal"]]
    if status == "PROVIDER_SUCCESS" and any(people[i]["key"] in step["asked"] or i in touched for i in open_):
        status, reason = "PROVIDER_PARTIAL", "EMAIL_MISSING"
    supplied = sorted({f"{people[i]['name']}:{f}" for i in order for f in people[i]["fields"]})
    kept = [{k: people[i][k] for k in ("ord", "contact_id", "name", "title", "title_priority", "email", "profile_url", "rank_score", "source_type", "origin", "replaced_email", "fields")} for i in order]
    return {"contacts": kept, "status": status, "reason": reason, "added": added, "upgraded": upgraded, "supplied": supplied, "emails": emails}


_WHOLE = ("ord", "seq", "title_priority", "tier", "rank", "strength")


def _plain(df: pd.DataFrame, order: str) -> pd.DataFrame:
    """Rows in order with None for nulls and whole numbers as such."""
    df = df[df[order].notna()].sort_values(order)
    out = df.astype(object).where(df.notna(), None)
    for c in set(_WHOLE) & set(out.columns):
        out[c] = pd.Series([None if v is None else int(v) for v in out[c]], out.index, object)
    return out


def _merger(target: int, limit: int):
    def merge(key, have: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = _merge(_plain(have, "ord"), _plain(found, "seq"), json.loads(found["step"].iloc[0]), target, limit)
        return pd.DataFrame({"company_id": [key[0]], "merged": [json.dumps(out)]})

    return merge


def waterfall(companies: DataFrame, contacts: DataFrame, outcomes: DataFrame, provided: DataFrame, providers: list[Provider], now: Column, scratch: Scratch, s: Settings = Settings(), calls: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contacts, attempts, emails) after the providers were asked in turn.

    companies(company_id, seq, domain) are qualified ones in the order in which a run asks; contacts as CONTACT, people
    in their order ``ord``; outcomes as OUTCOMES, a row for what consulting a provider about a company gives, and
    provided as PROVIDED, the people it names.  calls(company_id, provider, created_at) are earlier calls: one within
    the refresh window is answered from ``provided`` at no cost.  A provider that refuses (call_stop) is not called
    for the companies after; its budget of companies is spent in order; what it was not asked for is not merged.
    """
    domains = companies.select("company_id", "seq", "domain")
    people = contacts.withColumn("replaced_email", F.lit(None).cast("string")).withColumn("fields", F.create_map().cast(_FIELD))
    state = domains.withColumn("previous", F.lit(None).cast("string")).withColumn("prev_provider", F.lit(None).cast("string")).withColumn("prev_reason", F.lit(None).cast("string"))
    attempts, emails = [], []
    for k, provider in enumerate(providers):
        told = people.join(domains.select("company_id", "domain"), "company_id")
        told = told.withColumn("strength", email.email_strength(email.classify_email(F.lower("email"), F.col("domain")))).withColumn("personal", has_personal(F.col("email"), F.col("domain")))
        told = told.withColumn("key", text.person_key(F.col("name"))).withColumn("rank", source_rank(F.col("source_type"))).drop("domain")
        gaps = _gaps(told, s.contacts_target)
        asked = state.join(gaps, "company_id", "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))
        below = F.coalesce("strong", F.lit(0)) < s.contacts_target
        asked = asked.withColumn("d", decide(k == 0, F.col("previous"), F.col("prev_provider"), F.col("prev_reason"), below, F.col("missing")))
        mine = outcomes.where(F.col("provider") == provider.name)
        asked = _consulted(asked, mine, provider, now, None if calls is None else calls.where(F.col("provider") == provider.name))
        asked = scratch.save(asked, f"asked-{k}")
        step = F.to_json(F.struct(F.lit(provider.name).alias("provider"), F.col("status"), F.col("reason"), F.transform("missing", text.person_key).alias("asked"), F.lit((k + 1) * 10**12).alias("first_ord"), source_rank(F.lit(provider.name)).alias("rank")), {"ignoreNullFields": "false"})
        named = provided.where(F.col("provider") == provider.name).drop("provider")
        found = asked.where("answered").select("company_id", "domain", step.alias("step")).join(named, "company_id", "left")
        found = found.withColumn("strength", email.email_strength(email.classify_email(F.lower("email"), F.col("domain")))).withColumn("personal", has_personal(F.col("email"), F.col("domain")))
        found = found.withColumn("key", text.person_key(F.col("name"))).withColumn("tier", text.title_tier(F.col("title"))).drop("domain")
        theirs = told.drop("fields", "replaced_email").join(asked.where("answered").select("company_id"), "company_id", "left_semi")
        merged = theirs.groupBy("company_id").cogroup(found.groupBy("company_id")).applyInPandas(_merger(s.contacts_target, s.contacts_max), "company_id string, merged string")
        merged = scratch.save(merged.select("company_id", F.from_json("merged", _MERGED).alias("m")), f"merged-{k}")
        fresh = merged.select("company_id", F.inline("m.contacts"))
        fields = people.select("company_id", "ord", F.col("fields").alias("old"), F.col("replaced_email").alias("gone"))
        fresh = fresh.join(fields, ["company_id", "ord"], "left").select("company_id", *(c for c in fresh.columns if c not in ("company_id", "replaced_email", "fields")), F.coalesce("replaced_email", "gone").alias("replaced_email"), _overlay(F.col("old"), F.col("fields")).alias("fields"))
        untouched = people.join(merged.select("company_id"), "company_id", "left_anti")
        people = scratch.save(untouched.unionByName(fresh.select(people.columns)), f"people-{k}")
        done = asked.join(merged, "company_id", "left")
        tried = F.col("d.need").isNotNull()
        status = F.when(tried, F.coalesce("m.status", "status")).otherwise(F.lit("NOT_CALLED"))
        why = F.when(tried, F.coalesce("m.reason", "reason")).otherwise(F.col("d.reason"))
        one = done.select(
            "company_id", F.lit(k).alias("step"), F.lit(provider.name).alias("provider"), F.col("called"), status.alias("status"), why.alias("reason"), F.when(tried & F.lit(k > 0), F.col("d.reason")).alias("fallback_reason"),
            F.when(tried, F.col("d.need") == "full").alias("need_full"), F.when(tried, F.col("missing")).alias("need_people"), "match_method", "provider_company_id",
            F.coalesce("m.supplied", F.array().cast("array<string>")).alias("fields_supplied"), F.coalesce("m.added", F.lit(0)).alias("contacts_added"), F.coalesce("m.upgraded", F.lit(0)).alias("contacts_upgraded"),
            F.when(F.col("called"), F.coalesce("requests", F.lit(0))).otherwise(0).alias("requests"), (F.col("called") & F.coalesce("billable", F.lit(False))).alias("billable"), F.when(F.col("called"), F.coalesce("credits", F.lit(0.0))).otherwise(0.0).alias("credits"),
        )
        attempts.append(scratch.save(one, f"attempts-{k}"))
        emails.append(merged.select("company_id", F.lit(provider.name).alias("provider"), F.inline("m.emails")))
        last = attempts[-1].where("status <> 'NOT_CALLED'").select("company_id", F.col("status").alias("p"), F.col("provider").alias("pp"), F.col("reason").alias("pr"))
        moved = state.join(last, "company_id", "left")
        pick = lambda new, old: F.when(F.col("p").isNotNull(), F.col(new)).otherwise(F.col(old)).alias(old)
        state = moved.select("company_id", "seq", "domain", pick("p", "previous"), pick("pp", "prev_provider"), pick("pr", "prev_reason"))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return people, union(attempts), union(emails)


def _overlay(old: Column, new: Column) -> Column:
    from leadloom.operators.projections import merge_provenance

    return F.coalesce(merge_provenance(old, new), F.create_map().cast(_FIELD))


def _gaps(told: DataFrame, target: int) -> DataFrame:
    """(company_id, strong, missing): people of the tiers with a personal address, and the names of the leading ones without."""
    rows = told.where("title_priority is not null")
    listed = F.slice(F.array_sort(F.collect_list(F.struct("ord", "name", "personal"))), 1, target)  # a company keeps a handful of people
    by = rows.groupBy("company_id").agg(F.count_if("personal").alias("strong"), listed.alias("l"))
    return by.select("company_id", "strong", F.transform(F.filter("l", lambda p: ~p["personal"]), lambda p: p["name"]).alias("missing"))


def _consulted(asked: DataFrame, mine: DataFrame, provider: Provider, now: Column, calls: DataFrame | None) -> DataFrame:
    """asked and what consulting the provider gives: status, reason, called, answered, and the recorded outcome's columns.

    Companies beyond the budget, or after a refusal, get PROVIDER_UNAVAILABLE with the reason and are not called.
    """
    rows = asked.join(mine.drop("provider").withColumnsRenamed({"status": "o_status", "reason": "o_reason"}), "company_id", "left")
    if calls is None or provider.refresh_days is None:
        rows = rows.withColumn("cached", F.lit(False))
    else:
        newest = calls.groupBy("company_id").agg(F.max("created_at").alias("called_at"))
        rows = rows.join(newest, "company_id", "left").withColumn("cached", dates.within_days(F.col("called_at"), now, provider.refresh_days)).drop("called_at")
    rows = rows.withColumn("wants", F.col("d.need").isNotNull())
    queue = rows.where("wants and not cached").select("seq", "call_stop").orderBy("seq").limit(provider.max_companies)
    stop = queue.agg(F.max("seq").alias("last_seq"), F.min(F.when(F.col("call_stop").isin(vocab.PROVIDER_STOPS), F.struct("seq", "call_stop"))).alias("stop"))  # one row
    rows = rows.join(F.broadcast(stop))
    after = F.coalesce(F.col("seq") > F.col("stop.seq"), F.lit(False))
    spent = F.coalesce(F.col("seq") > F.col("last_seq"), F.lit(False))
    recorded = F.col("o_status").isNotNull()
    made = lambda status, reason, called, answered: F.struct(F.lit(status).cast("string").alias("status") if isinstance(status, str) else status.alias("status"), reason.cast("string").alias("reason"), F.lit(called).alias("called"), F.lit(answered).alias("answered"))
    down = "PROVIDER_UNAVAILABLE"
    got = (
        F.when(~F.col("wants"), made(F.lit(None).cast("string"), F.lit(None), False, False))
        .when(after, made(down, F.concat(F.lit("DISABLED_FOR_RUN_AFTER_"), F.col("stop.call_stop")), False, False))
        .when(F.lit(not provider.configured), made(down, F.lit("NOT_CONFIGURED"), False, False))
        .when(F.col("cached"), made("PROVIDER_SUCCESS", F.lit("CACHED"), False, True))
        .when(spent, made(down, F.lit("COMPANY_BUDGET_EXHAUSTED"), False, False))
        .when(recorded, made(F.col("o_status"), F.col("o_reason"), True, True))
        .otherwise(made("PROVIDER_ERROR", F.lit("NO_RECORDED_ANSWER"), False, False))
    )
    return rows.withColumn("g", got).select(*asked.columns, "g.*", "match_method", "provider_company_id", "requests", "credits", "billable")


# --- providers' answers ---------------------------------------------------------------------------------------------

COMPANY_JSON = "data struct<result:array<struct<data:array<struct<id:string,name:string,website:string,domainList:array<string>,employeeCount:string,primaryIndustry:string,city:string,state:string,country:string>>>>>"
PERSON_JSON = (
    "data struct<result:array<struct<data:array<struct<id:string,firstName:string,lastName:string,jobTitle:string,email:string,companyId:string,company:struct<id:string,name:string,website:string>,"
    "contactAccuracyScore:double,externalUrls:array<struct<type:string,url:string>>>>>>>"
)
PREVIEW_JSON = "data array<struct<id:string,firstName:string,lastName:string,jobTitle:string,hasEmail:boolean,contactAccuracyScore:double,company:struct<id:string>>>"
PEOPLE_JSON = "people array<struct<id:string,first_name:string,last_name_obfuscated:string,title:string,has_email:boolean>>"
MATCH_JSON = "person struct<id:string,name:string,title:string,email:string,linkedin_url:string,email_status:string,match_confidence:string,organization_id:string,organization:struct<id:string,primary_domain:string,website_url:string>>"


def result_rows(body: Column, schema: str) -> Column:
    """The rows of ``data.result[].data[]`` of an answer's text, flattened; a broken text has none."""
    read = F.from_json(body, schema)["data"]["result"]
    rows = F.flatten(F.transform(F.coalesce(read, F.array().cast(read_type(schema))), lambda r: F.coalesce(r["data"], F.array().cast(inner_type(schema)))))
    return F.coalesce(rows, F.array().cast(inner_type(schema)))


def read_type(schema: str) -> str:
    return schema.split("result:", 1)[1][:-1]


def inner_type(schema: str) -> str:
    return read_type(schema)[len("array<struct<data:") : -2]


def provider_call(code: Column, timed_out: Column, records: Column) -> Column:
    """struct(status, billable, credits) of one lookup: a credit a record; a sound answer without any is NO_MATCH."""
    failed = F.when(F.coalesce(timed_out, F.lit(False)), F.lit("PROVIDER_TIMEOUT")).when(code == 429, F.lit("PROVIDER_RATE_LIMITED")).when(code.isin(401, 403), F.lit("PROVIDER_UNAVAILABLE")).when(code >= 400, F.lit("PROVIDER_ERROR"))
    made = lambda status, billable, credits: F.struct(status.alias("status"), F.lit(billable).alias("billable"), credits.cast("double").alias("credits"))
    return F.when(failed.isNotNull(), made(failed, False, F.lit(0.0))).when(records == 0, made(F.lit("NO_MATCH"), True, F.lit(0.0))).otherwise(made(F.lit("SUCCESS"), True, records))


def parse_companies(answers: DataFrame) -> DataFrame:
    """answers(company_id, body) to candidates(company_id, cand_id, cand_name, website, domains, employee_count, state)."""
    rows = answers.select("company_id", F.explode(result_rows(F.col("body"), COMPANY_JSON)).alias("c"))
    return rows.select("company_id", F.col("c.id").alias("cand_id"), F.col("c.name").alias("cand_name"), F.col("c.website").alias("website"), F.coalesce("c.domainList", F.array().cast("array<string>")).alias("domains"), F.col("c.employeeCount").try_cast("int").alias("employee_count"), F.col("c.primaryIndustry").alias("industry"), F.col("c.state").alias("state"))


def _full_name(first: Column, last: Column) -> Column:
    return F.nullif(F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(last, F.lit(""))), F.lit(""))


def parse_people(answers: DataFrame) -> DataFrame:
    """answers(company_id, body) to full records: name, title, address, the first LinkedIn link, and the company they are said to work for."""
    rows = answers.select("company_id", F.posexplode(result_rows(F.col("body"), PERSON_JSON)).alias("seq", "p"))
    link = F.get(F.filter("p.externalUrls", lambda u: F.lower(F.coalesce(u["type"], F.lit(""))).contains("linkedin")), F.lit(0))["url"]
    return rows.select("company_id", "seq", F.col("p.id").alias("person_id"), _full_name(F.col("p.firstName"), F.col("p.lastName")).alias("name"), F.col("p.jobTitle").alias("title"), F.col("p.email").alias("email"), link.alias("profile_url"), F.coalesce("p.companyId", "p.company.id").alias("works_at"), (F.col("p.contactAccuracyScore") / 100).alias("confidence"))


def parse_previews(answers: DataFrame) -> DataFrame:
    """answers(company_id, body) to previews, which name people without their addresses."""
    rows = F.from_json("body", PREVIEW_JSON)["data"]
    out = answers.select("company_id", F.posexplode(rows).alias("seq", "p"))
    return out.select("company_id", "seq", F.col("p.id").alias("person_id"), _full_name(F.col("p.firstName"), F.col("p.lastName")).alias("name"), F.col("p.jobTitle").alias("title"), F.coalesce("p.hasEmail", F.lit(False)).alias("has_email"), F.col("p.contactAccuracyScore").alias("score"), F.col("p.company.id").alias("works_at"))


def wanted_previews(previews: DataFrame, matches: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Previews of people of the tiers at the matched company(company_id, provider_company_id), of those asked(company_id, name) only where given."""
    rows = previews.join(matches.select("company_id", "provider_company_id"), "company_id")
    rows = rows.where(text.title_tier(F.col("title")).isNotNull() & (F.col("works_at").isNull() | (F.col("works_at") == F.col("provider_company_id"))))
    if asked is not None:
        names = asked.select("company_id", text.person_key(F.col("name")).alias("key")).where("key is not null").distinct()
        rows = rows.withColumn("key", text.person_key(F.col("name"))).join(names, ["company_id", "key"], "left_semi").drop("key")
    return rows.drop("provider_company_id")


def worth_enriching(previews: DataFrame, contacts: DataFrame, domains: DataFrame, limit: int = 3) -> DataFrame:
    """The previews whose full record would fill a gap: with an address, of nobody whose personal one is known, by tier and accuracy, ``limit`` a company."""
    from pyspark.sql import Window

    strong = contacts.join(domains.select("company_id", "domain"), "company_id", "left").where(has_personal(F.col("email"), F.col("domain"))).select("company_id", text.person_key(F.col("name")).alias("key")).where("key is not null").distinct()
    rows = previews.where("has_email").withColumn("key", text.person_key(F.col("name"))).join(strong, ["company_id", "key"], "left_anti")
    order = Window.partitionBy("company_id").orderBy(text.title_tier(F.col("title")), -F.coalesce("score", F.lit(0.0)), "seq")
    return rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).drop("key", "k")


def first_provider(matches: DataFrame, previews: DataFrame, records: DataFrame, full: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(people, outcomes) of the provider that is asked for a company, then for previews, then for some full records.

    matches(company_id, reason, method, provider_company_id) as matching.match_provider_company gives them; previews
    wanted and records fetched; full(company_id) are companies asked about as a whole, for whom a preview without a
    full record still names a person.  People who are said to work elsewhere are left out.
    """
    good = matches.where("reason = 'MATCHED'")
    mine = records.join(good.select("company_id", "provider_company_id"), "company_id")
    here = mine.where(F.col("works_at").isNull() | (F.col("works_at") == F.col("provider_company_id")))
    told = here.select("company_id", "seq", "name", "title", "email", "profile_url", "person_id", F.lit("enrich_contact").alias("extraction_method"), "confidence")
    rest = previews.join(full.select("company_id"), "company_id", "left_semi").join(records.select("company_id", "person_id"), ["company_id", "person_id"], "left_anti")
    none = F.lit(None).cast("string")
    rest = rest.select("company_id", (F.col("seq") + 1000).alias("seq"), "name", "title", none.alias("email"), none.alias("profile_url"), "person_id", F.lit("search_contact").alias("extraction_method"), (F.col("score") / 100).alias("confidence"))
    people = told.unionByName(rest)
    n = people.groupBy("company_id").agg(F.count("*").alias("n"))
    out = matches.join(n, "company_id", "left")
    matched = F.col("reason") == "MATCHED"
    status = F.when(~matched | F.col("n").isNull(), F.lit("PROVIDER_NO_MATCH")).otherwise(F.lit("PROVIDER_SUCCESS"))
    why = F.when(~matched, F.col("reason")).when(F.col("n").isNull(), F.lit("NO_POC_FOUND"))
    return people, out.select("company_id", status.alias("status"), why.alias("reason"), F.when(matched, F.col("method")).alias("match_method"), F.when(matched, F.col("provider_company_id")).alias("provider_company_id"))


def lookups(asked: DataFrame, previews: DataFrame, contacts: DataFrame, domains: DataFrame, limit: int = 3) -> DataFrame:
    """(company_id, seq, person_id, expected_name): whom the second provider looks up.

    People asked(company_id, ord, name) come first, by name; then previews(company_id, seq, person_id, first_name,
    last_name_obfuscated, title, has_email) of the tiers with an address, by tier, unless they may be somebody whose
    personal address is known; ``limit`` a company.
    """
    from pyspark.sql import Window

    named = asked.where("coalesce(name, '') <> ''").select("company_id", F.lit(0).alias("part"), F.lit(0).alias("tier"), F.col("ord").alias("place"), F.lit(None).cast("string").alias("person_id"), F.col("name").alias("expected_name"))
    strong = contacts.join(domains.select("company_id", "domain"), "company_id", "left").where(has_personal(F.col("email"), F.col("domain")))
    known = strong.groupBy("company_id").agg(F.collect_set("name").alias("known"))  # a company keeps a handful of people
    rows = previews.where(F.col("has_email") & text.title_tier(F.col("title")).isNotNull()).join(known, "company_id", "left")
    from leadloom.functions.pages import obfuscated_same

    maybe = F.exists(F.coalesce("known", F.array().cast("array<string>")), lambda n: obfuscated_same(F.col("first_name"), F.col("last_name_obfuscated"), n))
    seen = rows.where(~maybe).select("company_id", F.lit(1).alias("part"), text.title_tier(F.col("title")).alias("tier"), F.col("seq").cast("long").alias("place"), "person_id", F.lit(None).cast("string").alias("expected_name"))
    w = Window.partitionBy("company_id").orderBy("part", "tier", "place")
    return named.withColumn("place", F.col("place").cast("long")).unionByName(seen).withColumn("seq", F.row_number().over(w)).where(F.col("seq") <= limit).select("company_id", "seq", "person_id", "expected_name")


def parse_matches(answers: DataFrame) -> DataFrame:
    """answers(company_id, seq, expected_name, body) to one person each with the organisation, and the credit that the call costs."""
    p = F.from_json("body", MATCH_JSON)["person"]
    rows = answers.withColumn("p", p)
    found = (F.coalesce("p.email", F.lit("")) != "") | F.coalesce(F.col("p.match_confidence") != "none", F.lit(False))
    org = F.coalesce("p.organization.primary_domain", "p.organization.website_url")
    return rows.select("company_id", "seq", "expected_name", F.col("p.id").alias("person_id"), F.col("p.name").alias("name"), F.col("p.title").alias("title"), F.col("p.email").alias("email"), F.col("p.linkedin_url").alias("profile_url"), org.alias("works_at"), F.coalesce("p.organization_id", "p.organization.id").alias("organization_id"), F.when(F.col("p").isNull(), F.lit("NO_MATCH")).otherwise(F.lit("SUCCESS")).alias("status"), F.when(F.col("p").isNotNull() & found, 1.0).otherwise(0.0).alias("credits"))


def second_provider(people: DataFrame, domains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(people, outcomes) of parse_matches: each person once, at this employer, and the one asked about where somebody was."""
    from leadloom.functions import url

    root = lambda c: url.registrable_domain(url.extract_host(c))
    rows = domains.where("coalesce(domain, '') <> ''").select("company_id", "domain").join(people, "company_id", "left")
    firsts = rows.where("person_id is not null").groupBy("company_id", "person_id").agg(F.min("seq").alias("seq"))
    once = rows.join(firsts, ["company_id", "person_id", "seq"], "left_semi")
    fits = (root(F.col("works_at")) == root(F.col("domain"))) & (F.col("expected_name").isNull() | (text.person_key(F.col("name")) == text.person_key(F.col("expected_name"))))
    judged = once.withColumn("fits", F.coalesce(fits, F.lit(False)))
    kept = judged.where("fits").select("company_id", "seq", "name", "title", "email", "profile_url", "person_id", F.lit("people_match").alias("extraction_method"), "organization_id")
    n = judged.groupBy("company_id").agg(F.count_if("fits").alias("kept"), F.count_if(~F.col("fits")).alias("dropped"), F.max_by("organization_id", F.when(F.col("fits"), F.col("seq"))).alias("provider_company_id"))
    out = domains.select("company_id", "domain").join(n, "company_id", "left")
    none = F.coalesce("kept", F.lit(0)) == 0
    unknown = F.coalesce("domain", F.lit("")) == ""
    status = F.when(unknown | none, F.lit("PROVIDER_NO_MATCH")).otherwise(F.lit("PROVIDER_SUCCESS"))
    why = F.when(unknown, F.lit("NO_DOMAIN_FOR_IDENTITY")).when(none, F.when(F.coalesce("dropped", F.lit(0)) > 0, F.lit("IDENTITY_UNRESOLVED")).otherwise(F.lit("NO_PERSON_MATCH")))
    return kept.drop("organization_id"), out.select("company_id", status.alias("status"), why.alias("reason"), F.lit("PERSON_ORGANIZATION_DOMAIN").alias("match_method"), "provider_company_id")


def profile_key(c: Column) -> Column:
    """The path of a personal profile's link, lower-cased and without a slash at its end, or null."""
    path = F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), r"linkedin\.com(/in/[^?#]*)", 1)
    return F.nullif(F.regexp_replace(path, "/+$", ""), F.lit(""))


def attach_profiles(asked: DataFrame, items: DataFrame, domains: DataFrame) -> DataFrame:
    """items(company_id, seq, profile_url, name, email, company_website) and verdict.

    ATTACHED only for a person asked(company_id, name, profile_url) about, by link and name, at a company whose own
    website is the employer's; else NOT_ASKED_FOR, DOMAIN_MISMATCH or LINKEDIN_WEBSITE_MISSING.
    """
    from leadloom.functions import url

    want = asked.select("company_id", profile_key(F.col("profile_url")).alias("link"), text.person_key(F.col("name")).alias("key")).where("link is not null").groupBy("company_id", "link").agg(F.max("key").alias("want"))
    rows = items.withColumn("link", profile_key(F.col("profile_url"))).join(want, ["company_id", "link"], "left").join(domains.select("company_id", "domain"), "company_id", "left")
    root = url.registrable_domain(url.extract_host(F.col("company_website")))
    site = F.when((F.coalesce(root, F.lit("")) != "") & ~root.isin(vocab.PLATFORM_HOSTS), root)
    same = F.coalesce(text.person_key(F.col("name")) == F.col("want"), F.lit(False))
    verdict = F.when(~same, F.lit("NOT_ASKED_FOR")).when(site == url.registrable_domain(url.extract_host(F.col("domain"))), F.lit("ATTACHED")).when(site.isNull(), F.lit("LINKEDIN_WEBSITE_MISSING")).otherwise(F.lit("DOMAIN_MISMATCH"))
    return rows.select(*items.columns, verdict.alias("verdict"))


def choose_actor_runs(runs: DataFrame) -> DataFrame:
    """Per company and job the run that counts: runs(company_id, job, place, actor, status, attached, reason).

    Actors are tried in order, the primary before the backup; the first that attached somebody ends the job, a refusal
    ends it too, and otherwise the last reason stays.
    """
    refused = F.col("status").isin(vocab.PROVIDER_STOPS)
    ends = F.when((F.col("attached") > 0) | refused, F.col("place"))
    last = runs.groupBy("company_id", "job").agg(F.min(ends).alias("end"), F.max("place").alias("all"))
    row = runs.join(last, ["company_id", "job"]).where(F.col("place") == F.coalesce("end", "all"))
    reason = F.when(F.col("status").isin(vocab.PROVIDER_FAILURES), F.concat("status", F.lit(":"), "actor")).when(F.col("attached") > 0, F.lit("ATTACHED")).otherwise(F.concat("reason", F.lit(":"), "actor"))
    return row.select("company_id", "job", "actor", F.col("attached"), reason.alias("reason"), F.col("place").alias("tried"))


def actor_outcomes(chosen: DataFrame, asked: DataFrame) -> DataFrame:
    """(company_id, status, reason) of a company's jobs: asked(company_id, domain, full, profiles), reasons joined where nobody was attached."""
    by = chosen.groupBy("company_id").agg(F.sum("attached").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("job", "reason"))), lambda s: s["reason"]), "; ").alias("reasons"), F.max(F.when(F.col("reason").rlike("^PROVIDER_"), F.substring_index("reason", ":", 1))).alias("failed"), F.min(F.col("reason").startswith("NO_CONFIRMED_ACTOR")).alias("only_missing"))
    rows = asked.join(by, "company_id", "left")
    no_domain, idle = F.coalesce("domain", F.lit("")) == "", ~F.col("full") & (F.col("profiles") == 0)
    found = F.coalesce("n", F.lit(0)) > 0
    status = F.when(no_domain | idle, F.lit("PROVIDER_NO_MATCH")).when(found, F.lit("PROVIDER_SUCCESS")).when(F.col("failed").isNotNull(), F.col("failed")).when(F.coalesce("only_missing", F.lit(True)), F.lit("PROVIDER_UNAVAILABLE")).otherwise(F.lit("PROVIDER_NO_MATCH"))
    reason = F.when(no_domain, F.lit("NO_DOMAIN_FOR_IDENTITY")).when(idle, F.lit("NO_LINKEDIN_PROFILE_URL")).when(~found, F.coalesce("reasons", F.lit("NO_CONFIRMED_ACTOR")))
    return rows.select("company_id", status.alias("status"), reason.alias("reason"))
