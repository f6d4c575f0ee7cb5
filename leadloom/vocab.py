"""Word lists, hosts, limits and code tables whose exact contents decide results."""

from __future__ import annotations

from dataclasses import dataclass

# US states and territories by name.
US_STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE",
    "district of columbia": "DC", "washington dc": "DC", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN",
    "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI",
    "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ",
    "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA",
    "puerto rico": "PR", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT",
    "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}
STATE_CODES = sorted(set(US_STATES.values()))
COUNTRY_PARTS = ["united states", "united states of america", "us", "usa", "u.s.", "u.s.a."]
NON_US_MARKERS = [
    "canada", "united kingdom", "india", "australia", "germany", "france", "mexico", "brazil", "ireland", "singapore", "philippines", "netherlands",
    "spain", "italy", "poland", "japan", "china", "remote, uk", ", uk", ", ca,",
]

# Hosts that name a platform, mailbox providers, and parts of recruiting vendors' host names.
PLATFORM_HOSTS = [
    "indeed.com", "linkedin.com", "ziprecruiter.com", "glassdoor.com", "google.com", "monster.com", "simplyhired.com", "careerbuilder.com", "dice.com",
    "snagajob.com", "craigslist.org", "jobcase.com", "talent.com", "adzuna.com", "jooble.org", "neuvoo.com", "lensa.com", "getwork.com", "recruit.net",
    "jobs2careers.com", "upward.net", "flexjobs.com", "wellfound.com", "angel.co", "builtin.com", "themuse.com", "hired.com", "remoteok.com",
    "weworkremotely.com", "ycombinator.com", "welcometothejungle.com", "postjobfree.com", "careerjet.com", "jobrapido.com", "jora.com", "nexxt.com",
    "ihire.com", "myjobhelper.com", "joblist.com", "ziprecruiter.co.uk", "workcircle.com", "trovit.com", "mitula.com", "greenhouse.io",
    "boards.greenhouse.io", "lever.co", "jobs.lever.co", "ashbyhq.com", "workday.com", "myworkdayjobs.com", "smartrecruiters.com", "bamboohr.com",
    "workable.com", "breezy.hr", "jazzhr.com", "applytojob.com", "recruitee.com", "personio.de", "teamtailor.com", "icims.com", "taleo.net",
    "successfactors.com", "oraclecloud.com", "paylocity.com", "paycomonline.net", "adp.com", "dayforcehcm.com", "ukg.com", "ultipro.com", "jobvite.com",
    "rippling.com", "gem.com", "pinpointhq.com", "hrmos.co", "keka.com", "darwinbox.com", "catsone.com", "careerplug.com", "entertimeonline.com",
    "facebook.com", "twitter.com", "x.com", "instagram.com", "youtube.com", "bit.ly", "tinyurl.com", "goo.gl", "t.co", "lnkd.in",
]
FREE_MAIL = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "mail.com", "protonmail.com", "gmx.com", "live.com", "msn.com", "me.com", "yandex.com", "zoho.com"]
ATS_TOKENS = [
    "hirebridge", "applicantpro", "applicantstack", "clearcompany", "workforcenow", "myworkday", "brassring", "silkroad", "clearstar", "jobappnetwork",
    "hiringthing", "smartsearchonline", "trakstar", "exacthire", "ninjagig", "hyrell", "bamboohr", "isolvedhire", "paycor", "kronos",
    "cornerstoneondemand", "peoplefluent", "ihire", "snaphire", "jobtarget", "talentreef", "fountain", "jobscore", "hiringplatform", "recruiterbox",
    "workbrightonboard", "greenhouse", "smartrecruiters", "successfactors", "taleo", "icims", "jazzhr", "applytojob", "myworkdayjobs", "ultipro",
    "dayforcehcm", "paycomonline",
]
SECOND_LEVEL = ["co", "com", "net", "org", "gov", "edu", "ac"]
JUNK_MAIL_DOMAINS = ["example.com", "example.org", "sentry.io", "wixpress.com", "domain.com", "email.com", "yourcompany.com", "company.com"]

# Legal forms that end a company name.
LEGAL_SUFFIXES = [
    "inc", "llc", "l.l.c", "corp", "corporation", "incorporated", "ltd", "limited", "co", "company", "gmbh", "ag", "plc", "llp", "lp", "pty", "pte", "sa",
    "sas", "bv", "nv", "oy", "ab", "as", "s.r.o", "s.p.a", "srl", "kg", "kk",
]

# Business words that don't tell companies apart.
NAME_NOISE = ["inc", "llc", "ltd", "corp", "corporation", "company", "co", "group", "holdings", "enterprises", "industries", "services", "solutions", "international", "usa", "us", "the", "and", "of"]

# Shared mailboxes.
ROLE_LOCALS = [
    "info", "contact", "hello", "support", "sales", "admin", "office", "help", "team", "careers", "jobs", "hr", "recruiting", "noreply", "no-reply",
    "donotreply", "webmaster", "postmaster", "marketing", "billing", "accounts", "enquiries", "inquiries", "general", "hrservicecenter", "humanresources",
    "human-resources", "talent", "talentacquisition", "recruiter", "recruiters", "recruitment", "staffing", "hiring", "employment", "apply",
    "applications", "resume", "resumes", "cv", "hrdept", "hrdepartment", "peopleops", "orders", "order", "service", "customerservice",
    "customer-service", "estimating", "estimates", "quotes", "quote", "dispatch", "accounting", "payroll", "purchasing", "shipping", "receiving",
    "reception", "frontdesk", "safety", "operations", "ops", "mail", "email", "feedback", "press", "media", "privacy", "legal", "compliance", "security",
]
ROLE_TOKENS = ["recruit", "staffing", "hiring", "career", "talent", "humanresource", "human-resource", "hrservice", "hr-service", "employment", "jobs"]

# Titles by priority tier, in normalized form.
TITLE_TIERS = {
    1: ["owner", "co owner", "ceo", "chief executive", "chief executive officer", "president", "managing partner"],
    2: ["coo", "chief operating officer", "vp operations", "vp of operations", "director of operations", "director operations", "operations director", "general manager"],
    3: [
        "hr director", "director of hr", "hr manager", "manager of hr", "head of hr", "human resources director", "director of human resources",
        "human resources manager", "manager of human resources", "head of human resources", "head of people", "people director", "director of people",
        "vp people", "vp of people", "chief people officer", "talent acquisition",
    ],
    4: ["plant manager", "operations manager"],
}
TITLE_EXCLUSIONS = ["assistant", "associate", "deputy", "former", "future", "aspiring", "owner operator", "product owner", "process owner"]
QUALIFIED_PRESIDENT = r"\b(?:(?:division|divisional|regional|region|area|group|district|segment|sector|business|unit|branch|market|zone) president|president (?:of|for)\b.*$)"

# Phrases that tell intermediaries, growth and talent-acquisition roles.
AGENCY_NAMES = [
    "staffing", "staff solutions", "recruiting", "recruitment", "recruiters", "headhunter", "head hunter", "talent agency", "talent solutions",
    "talent partners", "executive search", "search group", "search partners", "search firm", "staff augmentation", "contingent workforce",
    "employment agency", "personnel services", "manpower", "workforce solutions", "placement services", "placement agency", "hr solutions",
    "peo services", "temp agency", "temporary staffing", "rpo",
]
AGENCY_SELF = [
    "we are a staffing agency", "we are a recruiting firm", "our client is seeking", "our client is looking", "on behalf of our client",
    "we are recruiting on behalf", "staffing agency specializing", "recruitment agency specializing", "executive search firm", "we place candidates",
    "our staffing team", "client company is seeking",
]
GROWTH = [
    "newly created", "newly-created", "rapidly growing", "fast growing", "fast-growing", "expanding", "expansion", "growth", "scaling", "new facility",
    "new plant", "new location", "new site", "new branch", "second shift", "third shift", "additional shift", "increased demand", "record demand",
    "new contract", "new line", "capacity increase", "ramping up", "doubling", "restructuring", "operational change", "process improvement",
    "transformation", "modernization", "automation rollout",
]
TA_ROLES = [
    "talent acquisition", "recruiter", "recruiting manager", "recruiting coordinator", "sourcer", "head of talent", "talent partner",
    "people operations", "hris", "employer brand", "campus recruit", "technical recruiter",
]
TA_SENIOR = ["director of talent", "vp of talent", "vice president of talent", "head of talent acquisition", "chief people officer", "director of recruiting"]

# Where a source's URL names the company.
SOURCE_ID_PATTERNS = [
    ("indeed", r"(?:^|[/.])indeed\.com/cmp/([^/?#]+)"),
    ("linkedin", r"(?:^|[/.])linkedin\.com/company/([^/?#]+)"),
    ("greenhouse", r"(?:boards|job-boards)\.greenhouse\.io/([^/?#]+)"),
    ("lever", r"jobs\.lever\.co/([^/?#]+)"),
    ("ashby", r"jobs\.ashbyhq\.com/([^/?#]+)"),
    ("smartrecruiters", r"jobs\.smartrecruiters\.com/([^/?#]+)"),
    ("workable", r"apply\.workable\.com/(?!j/)([^/?#]+)"),
    ("bamboohr", r"//([a-z0-9-]+)\.bamboohr\.com"),
    ("breezy", r"//([a-z0-9-]+)\.breezy\.hr"),
    ("jazzhr", r"//([a-z0-9-]+)\.applytojob\.com"),
    ("recruitee", r"//([a-z0-9-]+)\.recruitee\.com"),
]
DOMAIN_SOURCES = ["COMPANY_WEBSITE", "COMPANY_URL", "APPLICATION_URL", "APPLY_URL", "OBSERVED_EMAIL"]
SECTORS = [
    "Manufacturing", "Construction", "Logistics & Transportation", "Warehousing & Distribution", "Food & Beverage", "Plastics/Rubber",
    "Industrial Equipment/Machinery", "Retail", "Hospitality/Hotels", "Property Management/Real Estate",
]


@dataclass(frozen=True)
class Settings:
    """Limits of the rules; defaults are the shipped configuration."""

    freshness_max_days: int = 14
    size_filter_min: int = 11
    size_filter_max: int = 200
    ta_reject_threshold: int = 4
    ta_review_threshold: int = 2
    linkedin_max_applicants: int = 20
    contacts_target: int = 3
    contacts_max: int = 6
    contacts_max_pages: int = 30
    size_cache_days: int = 90
    domain_cache_days: int = 180
    domain_negative_days: int = 7
    provider_refresh_days: int = 90
    verification_refresh_days: int = 30
    verification_max_per_run: int = 50
    max_companies_per_run: int = 25
    contacts_max_companies: int = 40
    verification_enabled: bool = True
    person_lookups: int = 3
    domain_max_candidates: int = 4
    domain_max_per_run: int = 150
    subdomain_max_hosts: int = 3
    detail_pages: int = 10
    pages_per_query: int = 25
    results_per_query: int = 1000
    full_snapshot: bool = False
    source_max_calls: int = 60
    title_variants: int = 5

# --- fixed values of pages ------------------------------------------------------------------------------------

#: Statuses that mean an access wall; marks that only such pages carry near their start; marks that count
#: in a title or on a page that is nearly empty; beginnings of documents that are short by nature.
BLOCK_STATUS = [401, 403, 407, 429, 503]
BLOCK_STRONG = [
    "cf-chl-", "cf_chl_opt", "__cf_chl", "/cdn-cgi/challenge-platform", "just a moment...", "attention required! | cloudflare", "checking your browser before accessing", "ddos-guard",
    "please verify you are a human", "are you a robot", "unusual traffic from your computer network", "access to this page has been denied", "px-captcha", "perimeterx",
    "incapsula incident id", "request unsuccessful. incapsula", "captcha-delivery.com", "g-recaptcha", "h-captcha", "hcaptcha.com/captcha", "bots use duckduckgo",
    "complete the following challenge", "confirm this search was made by a human", "select all squares containing", "our systems have detected unusual traffic",
]
BLOCK_WEAK = ["access denied", "403 forbidden", "blocked", "enable javascript", "javascript is required", "captcha"]
DOCUMENT_ROOTS = ["<?xml", "<urlset", "<sitemapindex"]
BLOCK_HEAD, LEAST_TEXT, WEAK_TEXT = 4000, 500, 1200

#: Words of a path that make a page about people, and of paths that never are one.
PEOPLE_PAGE_WORDS = ["team", "leadership", "about", "management", "executive", "executives", "people", "staff"]
NON_PEOPLE_SEGMENTS = ["blog", "blogs", "post", "posts", "news", "article", "articles", "press", "event", "events", "category", "tag", "careers", "career", "jobs", "job", "apply"]
CONTACT_PATH_TOKENS = ["contact", "team", "leadership", "management", "our-people", "people", "staff", "about-us", "who-we-are", "executive", "directory"]
COMPANY_SITE_PATHS = [
    "/leadership", "/team", "/our-team", "/management", "/about-us", "/about", "/company", "/who-we-are", "/staff", "/contact", "/contact-us", "/", "/leadership-team", "/our-people",
    "/people", "/executive-team", "/meet-the-team", "/careers", "/contact/", "/about/leadership",
]
BOARD_HOSTS = ["indeed.com", "linkedin.com", "ziprecruiter.com", "glassdoor.com", "monster.com", "simplyhired.com", "google.com"]
ATS_HOSTS = ["greenhouse.io", "lever.co", "ashbyhq.com", "myworkdayjobs.com", "smartrecruiters.com", "workable.com", "bamboohr.com", "icims.com"]
SUBDOMAIN_FIRST = ["careers", "jobs", "hr", "employment"]
SUBDOMAIN_SECOND = ["about", "company", "team", "people", "work"]
BLOCKED_HOSTS = ["localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback", "metadata", "metadata.google.internal", "metadata.goog", "instance-data"]
BLOCKED_SUFFIXES = [".localhost", ".local", ".internal", ".localdomain"]

#: Words that no person's name holds; words of a heading or an organisation; words of a sentence.
NOT_NAME_WORDS = [
    "email", "e-mail", "mail", "us", "here", "click", "contact", "call", "text", "message", "send", "reply", "apply", "now", "more", "info", "support", "help", "team", "sales", "careers",
    "jobs", "hr", "form", "learn", "read", "view", "download", "subscribe", "login", "sign", "chat", "today", "free", "get", "start", "request", "submit", "phone",
]
NOT_PERSON_WORDS = [
    "our", "meet", "leadership", "management", "executive", "executives", "staff", "about", "company", "board", "directors", "officers", "welcome", "team", "llc", "inc", "corp", "corporation",
    "co", "group", "services", "solutions", "construction", "electric", "industries", "industrial", "holdings", "department", "division", "office", "operations", "careers", "home",
]
SENTENCE_WORDS = [
    "the", "is", "are", "was", "were", "we", "our", "you", "your", "if", "can", "will", "this", "that", "please", "to", "with", "it", "be", "a", "an", "has", "have", "just", "may",
    "should", "site", "page", "website", "click", "contact", "email", "call", "who", "what", "when", "how", "not",
]
TITLE_WORDS = ["vice", "officer", "director", "manager", "chief", "head", "senior", "sr", "vp"]
ERROR_TITLES = ["not found", "404", "error", "access denied", "forbidden", "just a moment", "attention required", "unavailable", "cloudflare", "captcha"]

# --- fixed values of providers, leads and titles ------------------------------------------------------------------

#: Codes of a provider's answer that stand for failure, and those after which it is not asked again in a run.
PROVIDER_FAILURES = ["PROVIDER_NO_MATCH", "PROVIDER_ERROR", "PROVIDER_TIMEOUT", "PROVIDER_RATE_LIMITED", "PROVIDER_UNAVAILABLE"]
PROVIDER_STOPS = ["PROVIDER_RATE_LIMITED", "PROVIDER_UNAVAILABLE"]
LEAD_STATUSES = ["READY", "PENDING_VERIFICATION", "NO_VERIFIED_POC_EMAIL"]
STOP_TITLES = [
    "manager", "supervisor", "director", "engineer", "technician", "operator", "specialist", "coordinator", "analyst", "assistant", "associate", "clerk", "worker", "helper", "laborer",
    "owner", "president", "officer", "consultant",
]
EXCLUDED_SOC_MAJOR = "15-0000"
