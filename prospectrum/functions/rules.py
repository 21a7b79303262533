"""Rules of the records that come in from outside: the fields that break them.

Each function returns an array of field names, empty for a good record; V1 and
V5 also have the record as it is after trimming, lower-casing and defaults.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prospectrum.constants import CHANNELS, CRAWL_PATHS, SIGNAL_TYPES, STAGES
from prospectrum.functions import contacts
from prospectrum.functions.profiles import FIELDS, LISTS, bound
from prospectrum.functions.text import distinct_strings, js_trim, let

# Limits and choices of the rules.
SORTS = ["company_asc", "company_desc", "rank_asc"]
CRAWL_STATES = ["success", "partial", "failed"]
COMPANY_SORTS = ["name", "domain", "lastCrawledAt", "updatedAt"]
ORDERS = ["asc", "desc"]
TONES = ["professional", "consultative", "brief"]
URL_CHARS, PAGE_SIZES = 2048, (1, 100)
UUID = "(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def broken(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold; a null test is no break."""
    return F.filter(F.array(*[F.when(bad, name) for name, bad in rules.items()]), lambda x: x.isNotNull())


def not_between(x: Column, low: int, high: int) -> Column:
    """A text that is missing or has too few or too many characters."""
    return ~F.coalesce(F.length(x).between(low, high), F.lit(False))


def no_url(x: Column) -> Column:
    """Also for elements of arrays, where the parser of ``urls`` can't be called."""
    return not_between(x, 1, URL_CHARS) | F.try_parse_url(x, F.lit("PROTOCOL")).isNull()


def outside(x: Column, low: int, high: int) -> Column:
    """A number that is given and lies outside."""
    return F.coalesce(~x.between(low, high), F.lit(False))


@bound
def normalized_profile(p: Column) -> Column:
    """V1: a profile on its way in: trimmed, lower-cased where the field asks
    for it, repeated words of lists dropped, missing fields filled."""
    low = lambda f: F.lower(js_trim(p[f]))
    unknown = lambda x: F.coalesce(x, F.lit("unknown"))
    new = {f: js_trim(p[f]) for f in ("companyName", "description", "decisionMakerLinkedInUrl", "linkedInUrl", "xUrl")}
    new |= {"industry": low("industry"), "estimatedCompanySize": low("estimatedCompanySize"), "city": unknown(low("city")), "country": unknown(low("country"))}
    new |= {f: unknown(js_trim(p[f])) for f in ("decisionMaker", "revenue")}
    new |= {f: F.coalesce(distinct_strings(p[f]), F.array().cast("array<string>")) for f in LISTS}
    new |= {f: contacts.valid_email(p[f]) for f in ("email", "decisionMakerEmail")} | {f: contacts.valid_phone(p[f]) for f in ("phone", "decisionMakerPhone")}
    return F.struct(*[new[f].alias(f) for f in FIELDS])


def discovery_errors(query: Column, industry: Column, location: Column, limit: Column, excluded: Column) -> Column:
    """V2: what a search for companies is asked; 'unknown' hints count as none."""
    hint = lambda x: F.coalesce(F.length(js_trim(x)) > 200, F.lit(False))
    sites = F.coalesce((F.size(excluded) > 500) | F.exists(excluded, no_url), F.lit(False))
    return broken({"query": not_between(js_trim(query), 1, 2000), "industry": hint(industry), "location": hint(location), "limit": outside(limit, 1, 100), "excludedWebsites": sites})


def discovered_errors(name: Column, website: Column) -> Column:
    """V2: a company that a search found."""
    return broken({"companyName": not_between(name, 1, 500), "website": no_url(website)})


@bound
def crawl_errors(result: Column) -> Column:
    """V2: a crawl's result: domain, baseUrl, pages (path, url, contentText,
    html), status, pagesSucceeded, pagesAttempted."""
    page = lambda x: ~F.coalesce(x["path"].isin(CRAWL_PATHS), F.lit(False)) | no_url(x["url"]) | F.coalesce((F.length(x["contentText"]) > 50_000) | (F.length(x["html"]) > 500_000), F.lit(False))
    count = lambda f: ~F.coalesce(result[f] >= 0, F.lit(False))
    return broken({
        "domain": not_between(result["domain"], 1, 253), "baseUrl": no_url(result["baseUrl"]),
        "pages": result["pages"].isNull() | F.exists(result["pages"], page),
        "status": ~F.coalesce(result["status"].isin(CRAWL_STATES), F.lit(False)),
        "pagesSucceeded": count("pagesSucceeded"), "pagesAttempted": count("pagesAttempted"),
    })


def cleaning_errors(html: Column, bad_url: Column, path: Column, title: Column) -> Column:
    """A page to be cleaned; bad_url: whether its URL is none."""
    return broken({"html": not_between(html, 1, 500_000), "url": bad_url, "pagePath": not_between(path, 1, 500), "title": F.coalesce(F.length(title) > 500, F.lit(False))})


def cleaned_errors(body: Column, headings: Column) -> Column:
    """What cleaning gives back."""
    return broken({"body": F.coalesce(F.length(body) > 50_000, F.lit(False)), "headings": F.coalesce(F.exists(headings, lambda h: not_between(h["text"], 1, 500)), F.lit(False))})


def intent_errors(signals: Column) -> Column:
    """V2: an answer with buying signals: ten at most, each whole."""

    def bad(x: Column) -> Column:
        link = F.coalesce(no_url(x["sourceUrl"]) & x["sourceUrl"].isNotNull(), F.lit(False))
        return ~F.coalesce(x["type"].isin(SIGNAL_TYPES), F.lit(False)) | not_between(x["title"], 1, 500) | not_between(x["summary"], 1, 1 << 30) | link | ~F.coalesce(x["confidence"].between(0, 1), F.lit(False))

    return let(signals, lambda s: broken({"signals": s.isNull() | (F.size(s) > 10), "signal": F.coalesce(F.exists(s, bad), F.lit(False))}))


def search_request_errors(query: Column, limit: Column) -> Column:
    """V5: a new search."""
    return broken({"query": not_between(js_trim(query), 1, 500), "companyLimit": outside(limit, 1, 100)})


def parser_input_errors(query: Column, locale: Column) -> Column:
    """V2: what the query parser is asked; a locale need not be given."""
    return broken({"query": not_between(js_trim(query), 1, 500), "locale": locale.isNotNull() & not_between(locale, 2, 10)})


def company_list(page: Column, size: Column, industry: Column, domain: Column, sort: Column, order: Column) -> Column:
    """V5: a request for a page of companies, with defaults, and the fields
    that break its rules; page and size may be texts."""
    number = lambda x, default: F.when(x.isNull(), default).otherwise(x.try_cast("int"))
    at, most, term, host = number(page, 1), number(size, 25), js_trim(industry), js_trim(domain)
    errors = broken({
        "page": ~F.coalesce(at >= 1, F.lit(False)), "pageSize": ~F.coalesce(most.between(*PAGE_SIZES), F.lit(False)),
        "industry": industry.isNotNull() & not_between(term, 1, 200), "domain": domain.isNotNull() & not_between(host, 1, 253),
        "sort": F.coalesce(~sort.isin(COMPANY_SORTS), F.lit(False)), "order": F.coalesce(~order.isin(ORDERS), F.lit(False)),
    })
    return F.struct(at.alias("page"), most.alias("pageSize"), term.alias("industry"), host.alias("domain"), F.coalesce(sort, F.lit("updatedAt")).alias("sort"), F.coalesce(order, F.lit("desc")).alias("order"), errors.alias("errors"))


def schedule_errors(enabled: Column, interval_days: Column) -> Column:
    """V5: a refresh schedule; the interval is 30 days where none is given."""
    return broken({"enabled": enabled.isNull(), "intervalDays": outside(interval_days, 7, 90)})


def message_request_errors(company: Column, result: Column, tone: Column, channel: Column) -> Column:
    """V5: a request for an outreach message; all but the company may be missing."""
    uuid = lambda x: F.coalesce(x.rlike(UUID), F.lit(False))
    return broken({"companyId": ~uuid(company), "searchResultId": result.isNotNull() & ~uuid(result), "tone": F.coalesce(~tone.isin(TONES), F.lit(False)), "channel": F.coalesce(~channel.isin(CHANNELS), F.lit(False))})


def results_view(stage: Column, query: Column, sort: Column, page: Column, size: Column) -> Column:
    """V5: the state of a list of results, with defaults, and the fields that
    break its rules; page and size may be texts."""
    number = lambda x, default: F.when(x.isNull(), default).otherwise(x.try_cast("int"))
    at, most = number(page, 1), number(size, 10)
    errors = broken({
        "stage": F.coalesce(~stage.isin(STAGES), F.lit(False)), "sort": F.coalesce(~sort.isin(SORTS), F.lit(False)),
        "page": ~F.coalesce(at >= 1, F.lit(False)), "pageSize": ~F.coalesce(most.between(*PAGE_SIZES), F.lit(False)),
    })
    return F.struct(stage.alias("stage"), js_trim(query).alias("companyQuery"), F.coalesce(sort, F.lit("company_asc")).alias("sort"), at.alias("page"), most.alias("pageSize"), errors.alias("errors"))
