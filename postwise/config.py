"""Keyword lists, weights and thresholds.

Everything here is an argument of the operators (``Profile``); the defaults are
the fixed values the results must match. They are stated as plain text below.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must equal the original lists for identical results)
# ---------------------------------------------------------------------------

# Role phrases: a title matches if it contains any of these (lower-case substring).
TARGET_ROLES = (
    "senior software engineer", "senior java", "ai engineer", "ml engineer",
    "machine learning engineer", "senior platform engineer", "senior backend",
    "staff engineer", "staff software", "principal engineer", "principal software",
    "backend engineer", "platform engineer", "java developer", "java engineer",
    "software engineer", "senior developer", "senior engineer",
    "full stack engineer", "full stack developer", "full-stack engineer", "full-stack developer",
)

# Compound role match: any seniority word AND any craft word.
SENIORITY_WORDS = ("senior", "principal", "staff", "lead", "head of engineering", "engineering manager")
CRAFT_WORDS = ("engineer", "developer", "programmer", "architect", "devops", "sre", "data engineer")

# Location substrings.
LOCATION_WORDS = (
    "netherlands", "amsterdam", "rotterdam", "eindhoven", "utrecht",
    "delft", "hague", "den haag", "leiden", "groningen", "nl,", ", nl",
    "hilversum", "zoetermeer", "breda", "tilburg", "nijmegen",
    "veldhoven", "hoofddorp", "almere", "arnhem", "enschede",
)

# Whole-word title pattern for aggregator search rows (case-insensitive).
SEARCH_TITLE_WORDS = (
    "engineer", "developer", "architect", "scientist", "analyst", "platform", "backend",
    "fullstack", "data", "ml", "ai", "devops", "sre", "cloud",
)

# Search terms of the aggregator feed, rows kept per term, maximum age in hours.
SEARCH_TERMS = ("senior software engineer", "senior backend engineer", "platform engineer",
                "AI engineer", "staff engineer")
SEARCH_ROWS_PER_TERM = 25
SEARCH_MAX_AGE_HOURS = 168

# Skill terms for the rule score (3 points each, at most 70).
SKILL_TERMS = (
    "java", "python", "c#", "spring boot", "spring", "kotlin", "groovy",
    "microservices", "kubernetes", "k8s", "docker", "helm", "argocd",
    "ci/cd", "cicd", "kafka", "messaging", "event-driven", "postgresql",
    "mongodb", "cosmosdb", "redis", "gcp", "aws", "azure", "cloud",
    "platform", "devops", "sre", "ai", "llm", "langchain", "langgraph",
    "openai", "ml", "machine learning", "backend", "backend engineer",
    "software engineer", "platform engineer", "rest", "api", "rest api",
    "distributed", "scalability", "observability", "prometheus", "grafana",
    "elasticsearch", "fintech", "payments", "banking",
)
SKILL_POINTS = 3
SKILL_CAP = 70

# Role weights for the rule score (the maximum matching weight counts).
ROLE_WEIGHTS = (
    ("senior software engineer", 30),
    ("senior java", 30),
    ("senior backend engineer", 28),
    ("senior platform engineer", 28),
    ("ai engineer", 26),
    ("java engineer", 22),
    ("software engineer", 20),
    ("backend engineer", 18),
    ("platform engineer", 18),
)

# Penalties of the rule score.
SENIOR_TITLE_PENALTY = 20          # 'staff ' / ' staff' / 'principal' in the title text
VISA_FALSE_PENALTY = 20
RELOCATION_FALSE_PENALTY = 10
LANGUAGE_PHRASES = ("dutch speaking", "dutch language", "dutch required")
LANGUAGE_PENALTY = 30
SCORE_MIN, SCORE_MAX = 0, 99

# Score bands (threshold, colour); below the last threshold the default colour.
SCORE_BANDS = ((75, "#22c55e"), (55, "#f59e0b"))
SCORE_BAND_DEFAULT = "#94a3b8"

# Visa / relocation keywords in a description.
VISA_WORDS = ("visa", "kennismigrant", "highly skilled migrant", "sponsor")
RELOCATION_WORDS = ("relocation", "relocation package", "moving costs")

# Application-form page detector: has the marker, lacks both content words.
APPLY_FORM_MARKER = "autofill with mygreenhouse"
APPLY_FORM_CONTENT_WORDS = ("responsibilities", "requirements")

# E-mail filters. Fixed value: the local parts of role accounts, which are no recruiters.
ROLE_ACCOUNT_PATTERN = (r"(?i)^(noreply|no-reply|donotreply|support|info|hello|contact|privacy|legal|security|careers|jobs|apply|hr|talent|recruiting|notifications?|alerts?|news|feedback|abuse|postmaster|webmaster|admin|team|press|marketing|sales|billing|payments?|help|bot|automated|system)\b")
EMAIL_BLOCKED_DOMAIN_PARTS = ("sentry", "example", "test.", "amazonaws")
EMAIL_MIN_LOCAL = 3

# Anchor hrefs that look like job links, longest title kept, anchors read per page.
JOB_LINK_MARKERS = ("/job", "/career", "/vacatur", "/position", "/opening", "/role")
LINK_TITLE_MAX = 120
LINKS_PER_PAGE = 200

# Text lengths.
DESCRIPTION_MAX = 3000
PAGE_TEXT_MAX = 5000
PROMPT_DESCRIPTION_MAX = 2000
PLACEHOLDER_DESCRIPTION_MIN = 100

# Time windows.
CACHE_TTL_HOURS = 24
RETAIN_DAYS = 10
DAILY_LOOKBACK_HOURS = 24
DIGEST_TOP_K = 10

# Personal-data fields removed before publication.
PII_FIELDS = ("recruiter_email",)

# Default country used by several formats.
DEFAULT_COUNTRY = "Netherlands"
DEFAULT_CITY_LOCATION = "Amsterdam, Netherlands"

# Recursive JSON search (free-form payloads).
JSON_PROMISING_KEYS = (
    "jobs", "postings", "positions", "vacancies", "offers", "results",
    "data", "items", "listing", "jobPostings", "edges", "nodes", "hits",
    "content", "requisitions", "openings", "careers", "roles",
)
JSON_TITLE_KEYS = ("title", "name", "job_title", "position")
JSON_TITLE_OBJECT_KEYS = ("rendered", "text", "name")
JSON_LINK_KEYS = ("url", "link", "href", "applyUrl", "apply_url", "absolute_url", "hostedUrl", "jobUrl")
JSON_LOCATION_KEYS = ("location", "city", "office", "locationName", "country", "workplaceType")
JSON_LOCATION_OBJECT_KEYS = ("name", "city", "label", "country")
JSON_DATE_KEYS = ("datePosted", "date", "published_at", "publishedAt")
JSON_DESCRIPTION_KEYS = ("description", "descriptionHtml", "body", "content")
JSON_MAX_DEPTH = 8
JSON_FREE_DEPTH = 4

# Page-state variables of rendered pages, tried in this order.
PAGE_STATE_VARS = ("__NEXT_DATA__", "__NUXT__", "__INITIAL_STATE__", "__APP_STATE__")

# Provenance notes per source format.
NOTES = {
    "greenhouse": "Via Greenhouse board.",
    "icims": "Via iCIMS/Jibe API.",
    "lever": "Via Lever API.",
    "smartrecruiters": "Via SmartRecruiters API.",
    "ashby": "Via Ashby API.",
    "recruitee": "Via Recruitee API.",
    "picnic": "Via Picnic RSC slug extraction.",
    "homerun": "Via Homerun.",
    "kpmg_lunr": "Via KPMG lunr JSON.",
    "workday": "Via Workday API.",
    "bitvavo": "Via Bitvavo RSC endpoint.",
    "jsonld": "Via JSON-LD schema.",
    "jsonld_lenient": "Via JSON-LD (Playwright).",
    "nextdata": "Via __NEXT_DATA__.",
    "xhr": "Via XHR interception (Playwright).",
    "dom": "Via DOM link heuristic (Playwright).",
    "search": "Via LinkedIn / JobSpy.",
}

# URL formats of the source formats ({board}, {id}, {slug}, {path} are filled in).
URL_FORMATS = {
    "greenhouse_list": "https://boards-api.greenhouse.io/v1/boards/{board}/jobs?content=true",
    "greenhouse_job": "https://job-boards.greenhouse.io/{board}/jobs/{id}",
    "greenhouse_detail": "https://boards-api.greenhouse.io/v1/boards/{board}/jobs/{id}",
    "icims_job": "https://jobs.booking.com/booking/jobs/{id}",
    "lever_base": "https://api.lever.co/v0/postings",
    "smartrecruiters_list": "https://api.smartrecruiters.com/v1/companies/{board}/postings?limit=100&country=NLD",
    "ashby_list": "https://api.ashbyhq.com/posting-api/job-board/{board}",
    "recruitee_list": "https://{board}.recruitee.com/api/offers/",
    "recruitee_job": "https://{board}.recruitee.com/o/{slug}",
    "picnic_job": "https://jobs.picnic.app/en/jobs/engineering/{slug}/amsterdam/north-holland/netherlands",
    "kpmg_base": "https://www.werkenbijkpmg.nl",
    "kpmg_list": "https://www.werkenbijkpmg.nl/en/_lunr/vacancies_en",
    "workday_base": "https://{tenant}.wd{num}.myworkdayjobs.com",
    "workday_list": "https://{tenant}.wd{num}.myworkdayjobs.com/wday/cxs/{tenant}/{board}/jobs",
    "bitvavo_base": "https://jobs.bitvavo.com",
    "bitvavo_list": "https://jobs.bitvavo.com/find-your-role",
}

# Query parameters of the icims search and the categories it is asked for.
ICIMS_PARAMS = (("location", "Netherlands"), ("woe", "12"), ("regionCode", "NL"), ("stretchUnit", "MILES"),
                ("stretch", "25"))
ICIMS_CATEGORIES = ("Engineering", "Machine Learning")

# ---------------------------------------------------------------------------
# Text patterns (Java regex syntax; they must match what the
# original extraction rules match)
# ---------------------------------------------------------------------------
SCRIPT_BLOCK_PATTERN = r"(?is)<script[^>]*>.*?</script>"
STYLE_BLOCK_PATTERN = r"(?is)<style[^>]*>.*?</style>"
TAG_PATTERN = r"<[^>]+>"
MAILTO_PATTERN = r"""(?i)href=["']mailto:([^"'?#\s]+)"""
ADDRESS_PATTERN = r"\b([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})\b"
ISO_DATE_PATTERN = r"(\d{4}-\d{2}-\d{2})"
NUMERIC_JOB_ID_PATTERN = r"/jobs/(\d+)"
SLUG_CHARS_PATTERN = "[^a-z0-9]+"
SLUG_LIST_PATTERN = r"engineering/([a-z0-9-]+)/amsterdam"
TITLE_TAG_PATTERN = r"<title>([^<|]+)"
LD_SCRIPT_ANY_PATTERN = r"(?s)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"
LD_SCRIPT_TYPED_PATTERN = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
ATTRIBUTE_JSON_PATTERNS = (
    r"""(?s)v-bind:jobs=['"](.*?)['"](?=\s|>)""",
    r"""(?s):jobs=['"](.*?)['"](?=\s|>)""",
    r"""(?s)data-jobs=['"](.*?)['"](?=\s|>)""",
)
ISO_WEEK_DATE_PATTERN = r"^(\d{4})(?:-W(\d{2})(?:-([1-7]))?|W(\d{2})([1-7])?)(?:T.*)?$"
EMBEDDED_JOBS_PATTERN = r'"jobs":(\[.*?\])'
STATE_PAIR_PATTERN = r'"title"\s*:\s*"([^"]+)".*?"(?:url|href|link)"\s*:\s*"(https?://[^"]+)"'


@dataclass(frozen=True)
class Profile:
    """Keyword lists and weights; swap any of them per call."""

    roles: tuple = TARGET_ROLES
    seniority: tuple = SENIORITY_WORDS
    crafts: tuple = CRAFT_WORDS
    locations: tuple = LOCATION_WORDS
    skills: tuple = SKILL_TERMS
    role_weights: tuple = ROLE_WEIGHTS
    language_phrases: tuple = LANGUAGE_PHRASES
    search_title_words: tuple = SEARCH_TITLE_WORDS
    apply_form_marker: str = APPLY_FORM_MARKER
    apply_form_content_words: tuple = APPLY_FORM_CONTENT_WORDS
    role_accounts: str = ROLE_ACCOUNT_PATTERN
    email_blocked_domain_parts: tuple = EMAIL_BLOCKED_DOMAIN_PARTS
    email_min_local: int = EMAIL_MIN_LOCAL
    json_promising_keys: tuple = JSON_PROMISING_KEYS
    json_title_keys: tuple = JSON_TITLE_KEYS
    json_title_object_keys: tuple = JSON_TITLE_OBJECT_KEYS
    json_location_keys: tuple = JSON_LOCATION_KEYS
    json_location_object_keys: tuple = JSON_LOCATION_OBJECT_KEYS
    json_link_keys: tuple = JSON_LINK_KEYS
    json_date_keys: tuple = JSON_DATE_KEYS
    json_description_keys: tuple = JSON_DESCRIPTION_KEYS
    extra: dict = field(default_factory=dict)


DEFAULT_PROFILE = Profile()
