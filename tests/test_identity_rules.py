"""Companies and their verdicts on the driver's rows, against plain Python over all postings at once."""

import re
from collections import Counter

import pytest

from leadloom import vocab
from leadloom.functions import text
from leadloom.plans import queries as q
from tests.test_operators import whole

SF = "/root/testdata/sf0.001"
SIZES = {"51 to 200": (51, 200), "1,001 to 5,000": (1001, 5000), "10,000+": (10000, None), "fewer than 10": (None, 10), "200 employees": (200, 200), "1 to 50": (1, 50), "2k": (2000, 2000), None: (None, None)}


@pytest.fixture(scope="module")
def rows(spark):
    columns = ["ord", "company", "domain", "domain_source", "company_name_normalized", "company_name", "state", "source_ids", "source_site", "external_id", "evidence_url", "applicant_count", "company_employee_count", "title", "description", "age_days", "search_industry"]
    return sorted((r.asDict() for r in q.identified(spark, SF).select(columns).collect()), key=lambda r: r["ord"])


@pytest.fixture(scope="module")
def groups(rows):
    by = {}
    for r in rows:
        by.setdefault(r["company"], []).append(r)
    return by


def test_components_equal_the_sequential_rule(rows, groups):
    jobs = [{"ord": r["ord"], "domain": r["domain"], "web": r["domain_source"] in ("COMPANY_WEBSITE", "COMPANY_URL"), "name": r["company_name_normalized"], "state": r["state"], "ids": r["source_ids"]} for r in rows]
    assert sorted(sorted(r["ord"] for r in g) for g in groups.values()) == whole(jobs) and len(groups) > 100


def told(group):
    """A company's facts by the stated ties: names by count, length, alphabet; domains by source, then first seen; states by count, then first seen."""
    names = Counter(r["company_name_normalized"] for r in group)
    name = min(names, key=lambda n: (-names[n], -len(n), n))
    placed = [r for r in group if r["domain"]]
    best = min(placed, key=lambda r: (vocab.DOMAIN_SOURCES.index(r["domain_source"]), r["ord"]), default=None)
    states = Counter(r["state"] for r in group if r["state"])
    first = {s: min(r["ord"] for r in group if r["state"] == s) for s in states}
    top = min(states, key=lambda s: (-states[s], first[s]), default=None)
    ids = sorted({i for r in group for i in r["source_ids"]})
    head = group[0]
    if best:
        basis, key = ("DOMAIN" if best["domain_source"] in ("COMPANY_WEBSITE", "COMPANY_URL") else "EMPLOYER_URL"), f"domain:{best['domain']}"
    elif ids:
        basis, key = "SOURCE_ID", f"source:{ids[0]}"
    elif top:
        basis, key = "NAME_LOCATION", f"name:{name}|{top.lower()}"
    else:
        basis, key = "NAME_ONLY", f"name:{name}|posting:{head['source_site']}:{head['external_id'] or head['evidence_url']}"
    raw = [r["company_name"] for r in group if r["company_name"]]
    return {
        "company_name_normalized": name, "domain": best["domain"] if best else "", "identity_basis": basis, "identity_key": key, "hiring_intensity": len(group), "states": ",".join(sorted(states)),
        "source_sites": ",".join(sorted({r["source_site"] for r in group})), "min_applicant_count": min((r["applicant_count"] for r in group if r["applicant_count"] is not None), default=None), "company_name": max(raw, key=len) if raw else None,
    }


def test_rollups_equal_plain_python(spark, groups):
    want = {c: told(g) for c, g in groups.items()}
    shared = Counter(w["company_name_normalized"] for w in want.values())
    got = {r.company: r for r in q.company_rollup(spark, SF).collect()}
    assert set(got) == set(want)
    for c, facts in want.items():
        assert {k: got[c][k] for k in facts} == facts
        assert got[c].identity_ambiguous == (facts["identity_basis"] == "NAME_ONLY" and shared[facts["company_name_normalized"]] > 1)
        assert got[c].dedup_key == (f"{facts['domain']}|{facts['company_name_normalized'] or 'NO_NAME'}" if facts["domain"] else f"NO_DOMAIN|{facts['identity_key']}")


def found(phrases, value):
    return [m[0].lower() for m in re.finditer(text.phrase_pattern(phrases), value or "")]


def test_verdicts_equal_plain_python(spark, groups):
    got = {r.company: r for r in q.qualify_status(spark, SF).collect()}
    facts = {c: told(g) for c, g in groups.items()}
    shared = Counter(f["company_name_normalized"] for f in facts.values())
    for c, g in groups.items():
        reasons, flags, score = [], [], 12.0  # the sector asked for is the one observed
        agency = found(vocab.AGENCY_NAMES, facts[c]["company_name"]) or [h for r in g for h in found(vocab.AGENCY_SELF, r["description"])]
        lo, hi = SIZES[next((r["company_employee_count"] for r in g if r["company_employee_count"]), None)]
        ta = sum(bool(found(vocab.TA_ROLES, r["title"])) for r in g)
        senior = any(found(vocab.TA_SENIOR, r["title"]) for r in g)
        if agency:
            reasons.append("STAFFING_AGENCY")
        else:
            score += 25
        if lo is None and hi is None:
            flags.append("EMPLOYEE_SIZE_UNKNOWN")
        elif lo is not None and lo > 200:
            reasons.append("EMPLOYEE_SIZE_ABOVE_MAX")
        elif hi is not None and hi < 11:
            reasons.append("EMPLOYEE_SIZE_BELOW_MIN")
        elif lo is not None and hi is not None and lo >= 11 and hi <= 200:
            score += 15
        else:
            flags.append("EMPLOYEE_SIZE_SPANS_LIMIT")
        if ta >= 4 or (senior and ta >= 2):
            reasons.append("MATURE_INTERNAL_TA")
        elif ta >= 2:
            flags.append("POSSIBLE_INTERNAL_TA")
        if facts[c]["identity_basis"] == "NAME_ONLY" and shared[facts[c]["company_name_normalized"]] > 1:
            flags.append("AMBIGUOUS_COMPANY_IDENTITY")
        ages = [r["age_days"] for r in g if r["age_days"] is not None]
        age, n = min(ages, default=None), len(g)
        score += 0 if age is None else 15 if age <= 2 else 10 if age <= 7 else 6 if age <= 12 else 3
        score += 12 if n >= 5 else 9 if n >= 3 else 6 if n == 2 else 3
        growth = len({h for r in g for h in found(vocab.GROWTH, r["description"])})
        score += 10 if growth >= 3 else 7 if growth == 2 else 4 if growth else 0
        few = facts[c]["min_applicant_count"]
        score += 0 if few is None else 8 if few <= 20 else 3 if few <= 60 else 0
        status = "REJECTED" if reasons else "NEEDS_REVIEW" if flags else "QUALIFIED"
        r = got[c]
        assert (r.status, r.reasons, r.review_flags, r.score) == (status, ",".join(reasons), ",".join(flags), score), (c, facts[c])
