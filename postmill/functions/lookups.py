"""Fixed tables and the classifiers that read them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source priorities, legal suffixes, abbreviations, bands, ranks, phrases, regions, zones, aliases, board addresses.
ATS = ["greenhouse", "lever", "ashby", "workable", "smartrecruiters", "recruitee"]
FEEDS = ["remotive", "remoteok", "himalayas", "arbeitnow", "weworkremotely", "jobicy", "workingnomads", "themuse"]
AGGREGATOR_PREFIX, AGGREGATOR_PRIORITY, UNKNOWN_PRIORITY = "jobspy:", 2, 99
LEGAL_SUFFIXES = "inc incorporated llc llp ltd limited corp corporation co company gmbh mbh ag se bv nv sa sas srl spa ab as oy plc pty pte kk kft aps sro ug".split()
ABBREVIATIONS = {"sr": "senior", "snr": "senior", "jr": "junior", "mgr": "manager"}
ALIASES = {"postgres": "PostgreSQL", "k8s": "Kubernetes", "js": "JavaScript", "ts": "TypeScript", "gcp": "Google Cloud Platform", "aws": "Amazon Web Services", "ci": "Continuous Integration", "ml": "Machine Learning"}
BANDS = [
    ("director", ["director", "vp", "vice president", "head of"]), ("principal", ["principal", "distinguished", "fellow"]), ("staff", ["staff", "architect"]),
    ("lead", ["lead", "manager"]), ("senior", ["senior", "sr"]), ("intern", ["intern", "internship", "trainee", "apprentice"]), ("junior", ["junior", "jr", "associate", "graduate", "entry level"]),
]
RANKS = {"intern": 0, "junior": 1, "mid": 2, "senior": 3, "lead": 4, "staff": 4, "principal": 5, "director": 6}
NO_SPONSORSHIP = ["not able to sponsor", "unable to sponsor", "cannot sponsor", "do not sponsor", "does not sponsor", "no visa sponsorship", "without sponsorship", "not provide sponsorship", "not offer sponsorship", "no sponsorship", "must be authorized to work", "must be authorised to work"]
WORK_AUTH = [
    ("visa_holder", ["no sponsorship required", "without sponsorship", "not require sponsorship", "does not require sponsorship", "authorized to work", "authorised to work", "work permit", "h-1b holder", "h1b holder", "ead"]),
    ("needs_sponsorship", ["require sponsorship", "requires sponsorship", "requiring sponsorship", "need sponsorship", "needs sponsorship", "sponsorship required", "seeking sponsorship", "h-1b sponsorship", "h1b sponsorship", "visa sponsorship"]),
    ("permanent_resident", ["permanent resident", "green card", "greencard", "indefinite leave"]),
    ("citizen", ["citizen", "citizenship", "us national", "u.s. national"]),
]
REGIONS = {
    "US": ["united states", "u.s.", "usa", "us", "american", "america"], "GB": ["united kingdom", "uk", "u.k.", "britain", "british", "england", "london", "manchester", "edinburgh", "bristol", "leeds", "glasgow"],
    "EU": ["european union", "eu", "eea", "european", "europe"], "CA": ["canada", "canadian"], "AU": ["australia", "australian"], "NZ": ["new zealand"], "IN": ["india", "indian"],
    "DE": ["germany", "german", "berlin", "munich"], "FR": ["france", "french", "paris"], "NL": ["netherlands", "dutch", "amsterdam"], "IE": ["ireland", "irish", "dublin"],
    "PL": ["poland", "polish", "warsaw", "kraków", "krakow"], "SG": ["singapore"], "MX": ["mexico", "mexican"], "BR": ["brazil", "brasil", "brazilian"], "BG": ["bulgaria", "bulgarian", "sofia"],
    "TR": ["turkey", "türkiye", "turkish"], "TW": ["taiwan", "taipei"], "HK": ["hong kong"], "TH": ["thailand", "bangkok"], "AE": ["uae", "dubai"], "NO": ["norway", "norwegian"], "IT": ["italy", "italian"],
    "ES": ["spain", "spanish", "madrid", "barcelona"], "CH": ["switzerland", "swiss", "zurich"], "RO": ["romania", "romanian", "bucharest"], "PT": ["portugal", "portuguese", "lisbon"], "EG": ["egypt", "egyptian", "cairo"],
    "AR": ["argentina", "buenos aires"], "UY": ["uruguay", "montevideo"], "CO": ["colombia", "bogotá", "bogota"], "VN": ["vietnam", "ho chi minh", "hanoi"], "JP": ["japan", "tokyo"], "KR": ["south korea", "seoul"],
    "ZA": ["south africa", "cape town", "johannesburg"], "IL": ["israel", "tel aviv"], "SE": ["sweden", "stockholm"],
}
US_CITIES = ["san francisco", "new york", "seattle", "austin", "boston", "chicago", "los angeles", "denver", "atlanta", "portland", "starbase", "nashville", "houston", "mountain view"]
US_STATES = "ca ny tx wa ma il co ga or tn pa va az nc fl oh".split()
EU_MEMBERS = ["DE", "FR", "NL", "IE", "PL", "IT"]
GLOBAL_PHRASES = ["anywhere in the world", "worldwide", "work from anywhere", "fully remote", "global", "remote"]
CONTINENTS = ["americas", "north america", "latin america", "south america", "asia", "africa", "oceania", "europe", "emea", "apac"]
OFFSETS = {
    "US": (-10.0, -4.0), "CA": (-8.0, -3.5), "MX": (-8.0, -5.0), "BR": (-5.0, -2.0), "AR": (-3.0, -3.0), "UY": (-3.0, -3.0), "CO": (-5.0, -5.0), "GB": (0.0, 1.0), "IE": (0.0, 1.0), "PT": (0.0, 1.0), "EU": (0.0, 3.0),
    "DE": (1.0, 2.0), "FR": (1.0, 2.0), "NL": (1.0, 2.0), "PL": (1.0, 2.0), "IT": (1.0, 2.0), "ES": (1.0, 2.0), "CH": (1.0, 2.0), "SE": (1.0, 2.0), "NO": (1.0, 2.0), "BG": (2.0, 3.0), "RO": (2.0, 3.0), "EG": (2.0, 3.0),
    "ZA": (2.0, 2.0), "IL": (2.0, 3.0), "TR": (3.0, 3.0), "AE": (4.0, 4.0), "IN": (5.5, 5.5), "TH": (7.0, 7.0), "VN": (7.0, 7.0), "SG": (8.0, 8.0), "HK": (8.0, 8.0), "TW": (8.0, 8.0), "AU": (8.0, 11.0), "JP": (9.0, 9.0), "KR": (9.0, 9.0), "NZ": (12.0, 13.0),
}
ZONES = {"WET": 0.0, "GMT": 0.0, "UTC": 0.0, "BST": 1.0, "CET": 1.0, "CEST": 2.0, "EET": 2.0, "EEST": 3.0, "IST": 5.5, "EST": -5.0, "EDT": -4.0, "CST": -6.0, "PST": -8.0, "PDT": -7.0}
NOT_SLUGS = ["j", "embed", "api", "www", "jobs", "apply", "search"]
BOARD_PATTERNS = [
    ("greenhouse", r"https?://boards-api(?:\.eu)?\.greenhouse\.io/v1/boards/([A-Za-z0-9_-]+)"), ("lever", r"https?://api(?:\.eu)?\.lever\.co/v0/postings/([A-Za-z0-9_-]+)"),
    ("ashby", r"https?://api\.ashbyhq\.com/posting-api/job-board/([A-Za-z0-9_.-]+)"), ("workable", r"https?://apply\.workable\.com/api/v\d+/(?:widget/)?accounts/([A-Za-z0-9_-]+)"),
    ("smartrecruiters", r"https?://api\.smartrecruiters\.com/v1/companies/([A-Za-z0-9_-]+)"), ("greenhouse", r"https?://(?:job-boards|boards)(?:\.eu)?\.greenhouse\.io/embed/job_board(?:/js)?\?for=([A-Za-z0-9_-]+)"),
    ("greenhouse", r"https?://(?:job-boards|boards)(?:\.eu)?\.greenhouse\.io/(?!embed/)([A-Za-z0-9_-]+)"), ("lever", r"https?://jobs(?:\.eu)?\.lever\.co/([A-Za-z0-9_-]+)"),
    ("ashby", r"https?://jobs\.ashbyhq\.com/([A-Za-z0-9_.-]+)"), ("workable", r"https?://apply\.workable\.com/([A-Za-z0-9_-]+)"),
    ("smartrecruiters", r"https?://(?:jobs|careers)\.smartrecruiters\.com/([A-Za-z0-9_-]+)"), ("recruitee", r"https?://([A-Za-z0-9_-]+)\.recruitee\.com"),
]


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def whole_word(terms: list[str]) -> str:
    """One case-insensitive pattern for any of the terms as whole words, with explicit Unicode boundaries; null for null."""
    from .text import word_pattern

    return "(?i)" + "|".join(f"({word_pattern(t)[4:]})" for t in terms)


def names(text: Column, terms: list[str]) -> Column:
    """Does a text name any of the terms as a whole word; the pattern is tried only where one stands there at all."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(t.lower()) for t in terms]) & text.rlike(whole_word(terms))


def source_priority(source: Column) -> Column:
    """Boards before feeds before aggregators before anything unknown."""
    listed = literal_map({**dict.fromkeys(ATS, 0), **dict.fromkeys(FEEDS, 1)})
    return F.when(source.startswith(AGGREGATOR_PREFIX), F.lit(AGGREGATOR_PRIORITY)).otherwise(F.coalesce(F.try_element_at(listed, source), F.lit(UNKNOWN_PRIORITY)))


def band(title: Column) -> Column:
    """The first band, in order of precedence, whose keywords the title names; null when it names none."""
    return F.coalesce(*(F.when(names(title, words), name) for name, words in BANDS))


def rank(name: Column) -> Column:
    return F.try_element_at(literal_map(RANKS), name)


def band_distance(a: Column, b: Column) -> Column:
    """Positive where ``b`` is the more senior; null if either is unknown."""
    return rank(b) - rank(a)


def outside_window(seniority: str, window: int = 1) -> list[str]:
    """Title keywords of all bands further than ``window`` ranks from a band."""
    far = {name for name, r in RANKS.items() if abs(r - RANKS[seniority]) > window}
    return [w for name, words in BANDS if name in far for w in words]


def work_auth(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*(F.when(reduce(lambda a, b: a | b, [low.contains(p) for p in phrases]), name) for name, phrases in WORK_AUTH))


def regions_named(text: Column) -> Column:
    """Sorted codes of the regions that a text names as whole words; US cities and states count for US."""
    def codes(low: Column) -> Column:
        found = []
        for code, words in REGIONS.items():
            hit = reduce(lambda a, b: a | b, [low.contains(w.lower()) for w in words]) & text.rlike(whole_word(words))
            if code == "US":
                hit = hit | reduce(lambda a, b: a | b, [low.contains(c) for c in US_CITIES]) | text.rlike(r"(?i),\s*(" + "|".join(US_STATES) + r")([^\p{L}\p{N}_]|$)")
            found.append(F.when(hit, F.lit(code)))
        return F.array_sort(F.array_compact(F.array(*found)))

    return F.get(F.transform(F.array(F.lower(text)), codes), F.lit(0))


def open_to_world(text: Column, named: Column) -> Column:
    low = F.lower(text)
    continents = reduce(lambda a, b: a + b, [low.contains(c).cast("int") for c in CONTINENTS])
    phrase = reduce(lambda a, b: a | b, [low.contains(p) for p in GLOBAL_PHRASES])
    return (F.size(named) >= 3) | (continents >= 2) | ((F.size(named) == 0) & phrase)


def covers(authorised: Column, wanted: Column) -> Column:
    """Does a set of regions reach another; EU on either side stands for its members. An empty set reaches nothing."""
    members = F.array(*(F.lit(m) for m in EU_MEMBERS))
    wide = F.when(F.array_contains(authorised, "EU"), F.array_union(authorised, members)).otherwise(authorised)
    return (F.size(wanted) == 0) | (F.array_contains(wanted, "EU") & F.arrays_overlap(wide, members)) | F.arrays_overlap(wide, wanted)


def work_auth_regions(text: Column) -> Column:
    """Regions of clauses that allow, less those of clauses that demand sponsorship; null if none is left."""
    def phrases(name: str) -> str:
        return "(?i)" + "|".join(re.escape(p) for p in dict(WORK_AUTH)[name])

    def here(words: str, needing: bool):
        def clause(c: Column) -> Column:
            needs = c.rlike(phrases("needs_sponsorship")) & ~c.rlike(phrases("visa_holder"))
            return c.rlike(words) & (needs if needing else ~needs)

        return clause

    clauses = F.split(text, r"[.;]+")
    named = {code: whole_word(words) for code, words in REGIONS.items()}
    allowed, blocked = (F.array_compact(F.array(*(F.when(F.exists(clauses, here(words, needing)), F.lit(code)) for code, words in named.items()))) for needing in (False, True))
    left = F.array_sort(F.array_except(allowed, blocked))
    return F.when(F.size(left) > 0, left)
