"""The sources: where each keeps its records, and how a record becomes a posting.

Boards get the employer's name and slug with the payload; feeds and aggregators state the employer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import from_epoch_seconds, rfc2822, to_utc
from ..functions.lookups import literal_map
from ..functions.text import html_to_text, join_nonempty, url_key
from .payloads import elements


@dataclass
class Provider:
    """``complete``: absence from the source means that a posting is gone. ``stated``: records without one of these are no postings."""

    name: str
    envelope: str | None
    record: str
    fields: Callable[[Column], dict[str, Column]]
    keep: Callable[[Column], Column] | None = None
    board: bool = False
    complete: bool = True
    stated: tuple[str, ...] = ()


def _one(place: Column) -> Column:
    place = F.nullif(place, F.lit(""))
    return F.when(place.isNotNull(), F.array(place)).otherwise(F.array().cast("array<string>"))


def _known(list_col: Column) -> Column:
    return F.filter(F.coalesce(list_col, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def _or_one(many: Column, one: Column) -> Column:
    return F.when(F.size(many) > 0, many).otherwise(_one(one))


def _first(many: Column) -> Column:
    return F.try_element_at(many, F.lit(1))


def _mode(value: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(literal_map(names), value)


def _prose(*parts: Column) -> Column:
    return F.nullif(F.concat_ws("\n\n", *(F.nullif(p, F.lit("")) for p in parts)), F.lit(""))


def _greenhouse(r):
    return {"native": r["id"], "title": r["title"], "location": r["location"]["name"], "locations": _one(r["location"]["name"]), "remote_mode": F.lit(None).cast("string"),
            "description": html_to_text(html_to_text(r["content"])), "url": r["absolute_url"], "posted_at": to_utc(r["first_published"])}


def _lever(r):
    c = r["categories"]
    lists = F.array_join(F.transform(F.coalesce(r["lists"], F.array().cast("array<struct<text:string,content:string>>")), lambda x: F.concat_ws("\n", x["text"], x["content"])), "\n\n")
    return {"native": r["id"], "title": r["text"], "location": c["location"], "locations": _or_one(_known(c["allLocations"]), c["location"]), "remote_mode": _mode(r["workplaceType"], {"remote": "remote", "hybrid": "hybrid", "on-site": "onsite"}),
            "description": html_to_text(_prose(r["descriptionPlain"], lists, r["additionalPlain"])), "url": r["hostedUrl"], "posted_at": to_utc(r["createdAt"])}


def _ashby(r):
    more = F.transform(F.coalesce(r["secondaryLocations"], F.array().cast("array<struct<location:string>>")), lambda x: x["location"])
    return {"native": r["id"], "title": r["title"], "location": r["location"], "locations": _known(F.concat(F.array(r["location"]), more)), "remote_mode": _mode(F.lower(r["workplaceType"]), {"remote": "remote", "hybrid": "hybrid", "onsite": "onsite"}),
            "description": F.coalesce(F.nullif(r["descriptionPlain"], F.lit("")), html_to_text(r["descriptionHtml"]), r["descriptionPlain"]), "url": r["jobUrl"], "posted_at": to_utc(r["publishedAt"])}


def _workable(r):
    place = join_nonempty(r["city"], r["state"], r["country"])
    many = _known(F.transform(F.coalesce(r["locations"], F.array().cast("array<struct<city:string,region:string,country:string>>")), lambda x: join_nonempty(x["city"], x["region"], x["country"])))
    return {"native": r["shortcode"], "title": r["title"], "location": place, "locations": _or_one(many, place), "remote_mode": F.when(r["telecommuting"], "remote"),
            "description": html_to_text(r["description"]), "url": F.coalesce(r["url"], r["shortlink"]), "posted_at": to_utc(F.coalesce(r["published_on"], r["created_at"]))}


def _smartrecruiters(r):
    p = r["location"]
    place = F.coalesce(F.nullif(p["fullLocation"], F.lit("")), join_nonempty(p["city"], p["region"], p["country"]))
    s = r["jobAd"]["sections"]
    return {"native": r["id"], "title": r["name"], "employer": r["company"]["name"], "location": place, "locations": _one(place), "remote_mode": F.when(p["remote"], "remote").when(p["hybrid"], "hybrid").when(place.isNotNull(), "onsite"),
            "description": _prose(*(html_to_text(s[k]["text"]) for k in ("companyDescription", "jobDescription", "qualifications", "additionalInformation"))), "url": r["postingUrl"], "posted_at": to_utc(r["releasedDate"])}


def _recruitee(r):
    many = _known(F.transform(F.coalesce(r["locations"], F.array().cast("array<struct<name:string,city:string>>")), lambda x: F.coalesce(F.nullif(x["name"], F.lit("")), x["city"])))
    place = F.coalesce(F.nullif(r["location"], F.lit("")), _first(many))
    yes = lambda c: F.coalesce(r[c], F.lit(False))
    mode = F.when(yes("hybrid") | (yes("remote") & yes("on_site")), "hybrid").when(yes("remote"), "remote").when(yes("on_site"), "onsite")
    return {"native": r["id"], "title": r["title"], "employer": r["company_name"], "location": place, "locations": _or_one(many, place), "remote_mode": mode,
            "description": _prose(html_to_text(r["description"]), html_to_text(r["requirements"])), "url": r["careers_url"], "posted_at": to_utc(F.coalesce(r["published_at"], r["created_at"]))}


def _feed(native, title, employer, place, description, url, posted, mode="remote"):
    def fields(r):
        p = F.nullif(place(r), F.lit(""))
        m = mode(r) if callable(mode) else F.lit(mode).cast("string")
        return {"native": native(r), "title": title(r), "employer": F.trim(employer(r)), "location": p, "locations": _one(p), "remote_mode": m, "description": description(r), "url": url(r), "posted_at": posted(r)}

    return fields


def _himalayas(r):
    many = _known(r["locationRestrictions"])
    name = F.when(F.coalesce(r["companyName"], F.lit("name")) == "name", F.initcap(F.replace(r["companySlug"], F.lit("-"), F.lit(" ")))).otherwise(F.trim(r["companyName"]))
    return {"native": r["guid"], "title": r["title"], "employer": name, "location": _first(many), "locations": many, "remote_mode": F.lit("remote"),
            "description": F.coalesce(html_to_text(r["description"]), html_to_text(r["excerpt"])), "url": F.coalesce(r["applicationLink"], r["guid"]), "posted_at": from_epoch_seconds(r["pubDate"])}


def _themuse(r):
    many = _known(F.transform(F.coalesce(r["locations"], F.array().cast("array<struct<name:string>>")), lambda x: x["name"]))
    return {"native": r["id"], "title": r["name"], "employer": F.trim(r["company"]["name"]), "location": _first(many), "locations": many, "remote_mode": F.lit(None).cast("string"),
            "description": html_to_text(r["contents"]), "url": r["refs"]["landing_page"], "posted_at": to_utc(r["publication_date"])}


def weworkremotely(item: Column) -> dict[str, Column]:
    """An RSS item; ``Company: Title`` is parted at the first colon, without one both are the whole."""
    t = item["title"]
    cut = F.instr(t, ":")
    place = F.coalesce(F.nullif(item["region"], F.lit("")), join_nonempty(item["state"], item["country"]))
    return {"native": item["guid"], "title": F.when(cut > 0, F.trim(F.substring(t, cut + 1, F.length(t)))).otherwise(t), "employer": F.when(cut > 0, F.trim(F.substring(t, F.lit(1), cut - 1))).otherwise(t), "location": place, "locations": _one(place),
            "remote_mode": F.lit("remote"), "description": html_to_text(item["description"]), "url": F.coalesce(item["link"], item["guid"]), "posted_at": rfc2822(item["pubDate"])}


def _aggregated(r):
    whole = lambda c: F.nullif(F.trim(c), F.lit(""))
    native = F.coalesce(whole(r["id"]), F.substring(F.sha2(r["job_url"].cast("binary"), 256), 1, 16))
    place = whole(r["location"])
    return {"source": F.concat(F.lit("jobspy:"), r["site"]), "native": native, "title": r["title"], "employer": F.trim(r["company"]), "location": place, "locations": _one(place), "remote_mode": F.when(r["is_remote"], "remote"),
            "description": r["description"], "url": F.coalesce(whole(r["job_url_direct"]), r["job_url"]), "posted_at": to_utc(r["date_posted"])}


def _stated(r: Column, names: tuple[str, ...]) -> Column:
    """Blanks are no employer; elsewhere they are a value."""
    out = F.lit(True)
    for n in names:
        out = out & F.coalesce((F.trim(r[n]) if n == "company" else r[n]) != "", F.lit(False))
    return out


_TEXT = "struct<text:string>"
PROVIDERS = {p.name: p for p in [
    Provider("greenhouse", "jobs", "id string, title string, absolute_url string, location struct<name:string>, content string, first_published string", _greenhouse, board=True),
    Provider("lever", None, "id string, text string, hostedUrl string, createdAt string, workplaceType string, categories struct<location:string,allLocations:array<string>>, descriptionPlain string, lists array<struct<text:string,content:string>>, additionalPlain string", _lever, board=True),
    Provider("ashby", "jobs", "id string, title string, location string, secondaryLocations array<struct<location:string>>, workplaceType string, isListed boolean, descriptionPlain string, descriptionHtml string, jobUrl string, publishedAt string", _ashby, keep=lambda r: F.coalesce(r["isListed"], F.lit(True)), board=True),
    Provider("workable", "jobs", "shortcode string, title string, telecommuting boolean, city string, state string, country string, locations array<struct<city:string,region:string,country:string>>, url string, shortlink string, published_on string, created_at string, description string", _workable, board=True),
    Provider("smartrecruiters", "content", f"id string, name string, company struct<name:string>, location struct<city:string,region:string,country:string,remote:boolean,hybrid:boolean,fullLocation:string>, releasedDate string, postingUrl string, jobAd struct<sections:struct<companyDescription:{_TEXT},jobDescription:{_TEXT},qualifications:{_TEXT},additionalInformation:{_TEXT}>>", _smartrecruiters, board=True),
    Provider("recruitee", "offers", "id string, title string, company_name string, remote boolean, hybrid boolean, on_site boolean, location string, locations array<struct<name:string,city:string>>, description string, requirements string, careers_url string, published_at string, created_at string", _recruitee, board=True),
    Provider("remotive", "jobs", "id string, title string, company_name string, candidate_required_location string, publication_date string, url string, description string",
             _feed(lambda r: r["id"], lambda r: r["title"], lambda r: r["company_name"], lambda r: r["candidate_required_location"], lambda r: html_to_text(r["description"]), lambda r: r["url"], lambda r: to_utc(r["publication_date"]))),
    Provider("remoteok", None, "id string, position string, company string, location string, date string, url string, description string",
             _feed(lambda r: r["id"], lambda r: r["position"], lambda r: r["company"], lambda r: F.trim(F.regexp_replace(F.trim(r["location"]), "^[, ]+|[, ]+$", "")), lambda r: html_to_text(r["description"]), lambda r: r["url"], lambda r: to_utc(r["date"])), keep=lambda r: r["id"].isNotNull()),
    Provider("himalayas", "jobs", "title string, companyName string, companySlug string, locationRestrictions array<string>, pubDate string, applicationLink string, guid string, excerpt string, description string", _himalayas, complete=False),
    Provider("arbeitnow", "data", "slug string, company_name string, title string, remote boolean, location string, created_at string, url string, description string",
             _feed(lambda r: r["slug"], lambda r: r["title"], lambda r: r["company_name"], lambda r: r["location"], lambda r: html_to_text(r["description"]), lambda r: r["url"], lambda r: from_epoch_seconds(r["created_at"]), lambda r: F.when(r["remote"], "remote")), complete=False),
    Provider("jobicy", "jobs", "id string, jobTitle string, companyName string, jobGeo string, pubDate string, url string, jobExcerpt string, jobDescription string",
             _feed(lambda r: r["id"], lambda r: r["jobTitle"], lambda r: r["companyName"], lambda r: r["jobGeo"], lambda r: F.coalesce(html_to_text(r["jobDescription"]), html_to_text(r["jobExcerpt"])), lambda r: r["url"], lambda r: to_utc(r["pubDate"])), complete=False),
    Provider("workingnomads", None, "url string, title string, company_name string, location string, pub_date string, description string",
             _feed(lambda r: url_key(r["url"]), lambda r: r["title"], lambda r: r["company_name"], lambda r: r["location"], lambda r: html_to_text(r["description"]), lambda r: r["url"], lambda r: to_utc(r["pub_date"]))),
    Provider("themuse", "results", "id string, name string, company struct<name:string>, locations array<struct<name:string>>, refs struct<landing_page:string>, publication_date string, contents string", _themuse, complete=False),
    Provider("aggregator", None, "id string, site string, job_url string, job_url_direct string, title string, company string, location string, date_posted string, is_remote boolean, description string", _aggregated,
             complete=False, stated=("site", "title", "company", "job_url")),
]}
RSS_ITEM = "title string, region string, country string, state string, pubDate string, guid string, link string, description string"


def postings(records: DataFrame, fields: dict[str, Column], name: str, board: bool, raw: Column) -> DataFrame:
    """Posting rows of records; boards need columns company and slug."""
    f = dict(fields)
    source = f.pop("source", F.lit(name))
    native, employer = f.pop("native").cast("string"), f.pop("employer", None)
    company = F.coalesce(employer, F.col("company")) if board and employer is not None else F.col("company") if board else employer
    prefix = F.col("slug") if board else source
    return records.select(source.alias("source"), F.concat(prefix, F.lit(":"), native).alias("external_id"), f["title"].alias("title"), company.alias("company"), F.lit(None).cast("string").alias("company_id"),
                          *(f[k].alias(k) for k in ("location", "locations", "remote_mode", "description", "url")), (F.lit(name) if board else F.lit(None).cast("string")).alias("ats_type"), f["posted_at"].alias("posted_at"), raw.alias("raw_json"))


def normalize(payloads: DataFrame, name: str, stated: tuple[str, ...] | None = None) -> DataFrame:
    """Postings of a provider's payloads (payload, and company and slug for a board). ``stated``: what records must state, if not what the provider asks for."""
    p = PROVIDERS[name]
    rows = payloads.select(*(c for c in ("company", "slug") if p.board), F.explode(elements(F.col("payload"), p.envelope)).alias("raw"))
    rows = rows.withColumn("r", F.from_json("raw", p.record))
    if p.keep:
        rows = rows.where(p.keep(F.col("r")))
    rows = rows.where(_stated(F.col("r"), p.stated if stated is None else stated))
    return postings(rows, p.fields(F.col("r")), name, p.board, F.col("raw"))


def normalize_rss(payloads: DataFrame) -> DataFrame:
    """Postings of feeds of RSS items (payload: one item's XML)."""
    rows = payloads.withColumn("r", F.from_xml("payload", RSS_ITEM))
    return postings(rows, weworkremotely(F.col("r")), "weworkremotely", False, F.to_json("r"))


def read_rss(spark, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path)
    r = F.struct(*rows.columns)
    return postings(rows.select(r.alias("r")), weworkremotely(F.col("r")), "weworkremotely", False, F.to_json("r"))


def merge_details(listed: DataFrame, details: DataFrame, changed: DataFrame, key: str = "external_id") -> DataFrame:
    """Description and address of a detail record, for changed rows only; the raw payload stays as listed."""
    extra = details.join(changed.select(key), key, "left_semi").select(key, F.col("description").alias("__d"), F.col("url").alias("__u"))
    return listed.join(extra, key, "left").withColumns({"description": F.coalesce("__d", "description"), "url": F.coalesce("__u", "url")}).drop("__d", "__u")
