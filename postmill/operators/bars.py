"""Bars: deterministic reasons why a posting and a candidate don't fit. Unknown never bars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions.text import let

# Demands and evidence.
LANGUAGES = [("Mandarin", r"bilingual [^.]{0,30}mandarin|mandarin (?:is )?required", ["mandarin", "chinese"]),
             ("German", r"fluent in german|flie\wend|deutschkenntnisse in wort", ["german", "deutsch"]), ("French", r"fluent in french|couramment (?:le )?fran\wais", ["french", "français"])]
STUDENTS = r"current university students and recent graduates|open (?:only )?to (?:current )?students|must be currently enrolled"
PAST_STUDY = ["mid", "senior", "staff", "principal", "lead"]
FAMILIES = [("sales engineering", ["sales engineer", "solutions engineer", "solution engineer", "account executive"], ["sales engineer", "solutions engineer", "account executive", "quota"]),
            ("customer-facing architecture", ["solutions architect", "solution architect"], ["solutions architect", "solution architect", "presales", "pre-sales"]),
            ("technical support", ["support engineer", "technical support"], ["support engineer", "technical support", "helpdesk", "service desk"])]
ZONE_WINDOW = r"(?i)(?:^|[^\p{L}\p{N}_])(CET|CEST|EET|EEST|WET|GMT|UTC|BST|EST|EDT|CST|PST|PDT|IST)(?![\p{L}\p{N}_])[^.\n]{0,20}?[+±]/?-\s*(\d+(?:\.\d+)?)\s*h"
CODING = [("PHP", r"php", ["php", "laravel", "symfony"]), ("Ruby", r"ruby(?: on rails)?", ["ruby", "rails"]), ("Go", r"go(?:lang)?", ["golang", " go ", " go,", "go."]), ("Java", r"java", ["java"]), ("C#", r"c#|\.net", ["c#", ".net", "asp.net"]),
          ("Rust", r"rust", ["rust"]), ("Scala", r"scala", ["scala"]), ("Elixir", r"elixir(?:/phoenix)?", ["elixir", "phoenix"]), ("Kotlin", r"kotlin", ["kotlin"])]
MANDATORY = r"(?:is a must|is required|is mandatory|must have|are required|is essential)"


def _any(text: Column, words: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def country_bar(places: Column, authorised: Column) -> Column:
    """Places that name regions which the authorised ones don't reach. A null authorisation is unknown, an empty one is not."""
    joined = F.array_join(places, " ")
    home = F.coalesce(F.nullif(F.array_join(F.array_sort(authorised), "/"), F.lit("")), F.lit("nowhere stated"))

    def bar(wanted: Column) -> Column:
        barred = authorised.isNotNull() & (F.size(places) > 0) & (F.size(wanted) > 0) & ~L.open_to_world(joined, wanted) & ~L.covers(authorised, wanted)
        return F.when(barred, F.concat(F.lit("role is based in "), F.array_join(wanted, "/"), F.lit("; profile is authorised to work in "), home))

    return let(L.regions_named(joined), bar)


def _first(rules: list[Column]) -> Column:
    return F.coalesce(*rules)


def language_bar(haystack: Column, resume: Column) -> Column:
    return _first([F.when(haystack.rlike(f"(?iU){demand}") & ~_any(resume, words), f"posting requires {name}; the résumé does not mention it") for name, demand, words in LANGUAGES])


def student_bar(description: Column, seniority: Column) -> Column:
    what = F.lower(F.regexp_extract(F.coalesce(description, F.lit("")), f"(?i)({STUDENTS})", 1))
    return F.when(F.lower(seniority).isin(PAST_STUDY) & (what != ""), F.concat(F.lit("programme is limited to "), what, F.lit("; profile is "), seniority))


def family_bar(title: Column, resume: Column) -> Column:
    return _first([F.when(_any(title, names) & ~_any(resume, words), f"role is {name}; the résumé shows no experience in it") for name, names, words in FAMILIES])


def zone_window(text: Column) -> Column:
    """(lo, hi) in hours from UTC of a stated zone with a tolerance; null without one."""
    zone, hours = F.upper(F.regexp_extract(text, ZONE_WINDOW, 1)), F.regexp_extract(text, ZONE_WINDOW, 2).try_cast("double")
    centre = F.try_element_at(L.literal_map(L.ZONES), zone)
    return F.when(centre.isNotNull() & hours.isNotNull(), F.struct((centre - hours).alias("lo"), (centre + hours).alias("hi")))


def region_spans(codes: Column) -> Column:
    lo, hi = L.literal_map({k: v[0] for k, v in L.OFFSETS.items()}), L.literal_map({k: v[1] for k, v in L.OFFSETS.items()})
    return F.filter(F.transform(codes, lambda c: F.struct(F.try_element_at(lo, c).alias("lo"), F.try_element_at(hi, c).alias("hi"))), lambda s: s["lo"].isNotNull())


def zone_bar(text: Column, home: Column) -> Column:
    """A stated window that no region of the home locations overlaps; a range left open stays open."""
    window, spans = zone_window(text), region_spans(L.regions_named(F.array_join(home, " ")))
    meets = F.exists(spans, lambda s: (s["lo"] <= window["hi"]) & (s["hi"] >= window["lo"]))
    return F.when(window.isNotNull() & (F.size(spans) > 0) & ~meets, F.lit("working hours are out of reach"))


def coding_bar(haystack: Column, resume: Column) -> Column:
    rules = []
    for name, pattern, words in CODING:
        demand = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{pattern})(?:(?=[^\p{{L}}\p{{N}}_])|$)(?:[^.\n]|\.\d){{0,40}}?{MANDATORY}"
        rules.append(F.when(haystack.rlike(demand) & ~_any(resume, words), f"posting states {name} as mandatory; the résumé does not mention it"))
    return _first(rules)


def bars(*found: Column) -> Column:
    """Those that hold, in their order."""
    return F.array_compact(F.array(*found))
