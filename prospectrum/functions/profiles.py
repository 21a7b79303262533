"""Company profiles: merge, gaps, completeness, eligibility, recipients.

A profile is a struct column of ``PROFILE`` fields; readers accept structs
that lack fields (``whole`` fills them in). A function that looks at many of
its fields binds the profile first, so that plans hold what made it once.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospectrum.constants import COMPLETENESS, INDUSTRY_GROUPS
from prospectrum.functions import contacts
from prospectrum.functions.text import EMPTY_LABEL, distinct_strings, display_value, is_unknown, js_trim, let
from prospectrum.functions.urls import is_company_page, is_personal_profile

TEXTS = ["companyName", "description", "industry", "estimatedCompanySize", "city", "country", "decisionMaker", "revenue"]
LISTS = ["products", "services", "targetCustomers"]
OPTIONAL = ["decisionMakerEmail", "decisionMakerPhone", "decisionMakerLinkedInUrl", "linkedInUrl", "xUrl", "email", "phone"]
FIELDS = list(COMPLETENESS)
PROFILE = T.StructType([T.StructField(f, T.ArrayType(T.StringType()) if f in LISTS else T.StringType()) for f in FIELDS])
EMPLOYEE_RANGE = "^(?:\\d+-\\d+|\\d+\\+|unknown)$"


def bound(function):
    """The function with its first argument, a profile, computed once."""

    @wraps(function)
    def once(p: Column, *more: Column) -> Column:
        return let(p, lambda v: function(v, *more))

    return once


def parsed(json: Column) -> Column:
    """A profile from JSON text; missing fields are null."""
    return F.from_json(json, PROFILE, {"mode": "PERMISSIVE"})


@bound
def whole(p: Column) -> Column:
    """Missing texts become 'unknown', missing lists empty."""
    fill = lambda f: F.coalesce(p[f], F.lit("unknown")) if f in TEXTS else F.coalesce(p[f], F.array().cast("array<string>")) if f in LISTS else p[f]
    return F.struct(*[fill(f).alias(f) for f in FIELDS])


def stub(name: Column, industry: Column, city: Column, country: Column, size: Column) -> Column:
    """a profile of what discovery knows."""
    known = {"companyName": name, "description": F.concat(name, F.lit(" company")), "industry": industry, "city": city, "country": country, "estimatedCompanySize": size}
    return whole(F.struct(*[known.get(f, F.lit(None).cast(PROFILE[f].dataType)).alias(f) for f in FIELDS]))


def merged(preferred: Column, fallback: Column) -> Column:
    """known texts of the preferred profile win, arrays unite."""
    return let(preferred, lambda a: let(fallback, lambda b: _merged(a, b)))


def _merged(preferred: Column, fallback: Column) -> Column:
    def text(f: str) -> Column:
        return F.when(~is_unknown(preferred[f]), js_trim(preferred[f])).when(~is_unknown(fallback[f]), js_trim(fallback[f])).otherwise("unknown")

    def optional(f: str) -> Column:
        blank = lambda v: F.when(js_trim(v) != "", js_trim(v))
        return F.coalesce(blank(preferred[f]), blank(fallback[f]))

    empty = F.array().cast("array<string>")
    pick = lambda f: text(f) if f in TEXTS else optional(f) if f in OPTIONAL else distinct_strings(F.concat(F.coalesce(preferred[f], empty), F.coalesce(fallback[f], empty)))
    return F.struct(*[pick(f).alias(f) for f in FIELDS])


@bound
def gap_count(p: Column) -> Column:
    """F32: how many of seven facts are missing."""
    unknown = [is_unknown(p[f]) for f in ("city", "country", "decisionMaker", "estimatedCompanySize", "revenue")]
    missing = [F.coalesce(p[f], F.lit("")) == "" for f in ("linkedInUrl", "email")]
    return sum((x.cast("int") for x in [*unknown, *missing]), F.lit(0))


@bound
def has_personal_gap(p: Column) -> Column:
    """F32: no decision maker, or none of their contacts."""
    some = [js_trim(F.coalesce(p[f], F.lit(""))) != "" for f in ("decisionMakerEmail", "decisionMakerPhone", "decisionMakerLinkedInUrl")]
    return is_unknown(p["decisionMaker"]) | ~(some[0] | some[1] | some[2])


@bound
def completeness(p: Column) -> Column:
    """weights of the facts present, added in order, to three places."""
    filled = lambda f: F.coalesce(p[f], F.lit("")) != ""
    known = lambda f: F.coalesce(p[f] != "unknown", F.lit(True))
    tests = {f: F.coalesce(F.size(p[f]), F.lit(0)) > 0 for f in LISTS} | {f: filled(f) for f in [*OPTIONAL, "companyName"]}
    tests |= {f: known(f) for f in ("estimatedCompanySize", "city", "country", "decisionMaker", "revenue")}
    tests |= {"description": F.coalesce(F.length(p["description"]), F.lit(0)) >= 20, "industry": filled("industry") & known("industry")}
    total = F.lit(0.0)
    for field, weight in COMPLETENESS.items():
        total = total + F.when(tests[field], weight).otherwise(0.0)
    return F.floor(total * 1000 + 0.5) / 1000


@bound
def sanitized(p: Column) -> Column:
    """formats checked, then what a person's contacts must not be."""
    phone, own_phone = contacts.valid_phone(p["phone"]), contacts.valid_phone(p["decisionMakerPhone"])
    url, company = js_trim(p["decisionMakerLinkedInUrl"]), p["linkedInUrl"]
    same_page = F.coalesce(is_company_page(company) & (url == js_trim(company)), F.lit(False))
    link = F.when((p["decisionMakerLinkedInUrl"] == "") | (is_personal_profile(url) & ~same_page), p["decisionMakerLinkedInUrl"])
    new = {
        "email": contacts.valid_email(p["email"]),
        "phone": phone,
        "decisionMakerEmail": contacts.personal_email(p["decisionMakerEmail"], p["email"]),
        "decisionMakerPhone": F.when(~F.coalesce(contacts.phone_digits(own_phone) == contacts.phone_digits(phone), F.lit(False)), own_phone),
        "decisionMakerLinkedInUrl": link,
    }
    return F.struct(*[new.get(f, p[f]).alias(f) for f in FIELDS])


@bound
def with_hints(p: Column, email: Column, link: Column) -> Column:
    """hints fill what is null."""
    new = {"decisionMakerEmail": F.coalesce(p["decisionMakerEmail"], email), "decisionMakerLinkedInUrl": F.coalesce(p["decisionMakerLinkedInUrl"], link)}
    return F.struct(*[new.get(f, p[f]).alias(f) for f in FIELDS])


@bound
def has_any_contact(p: Column) -> Column:
    """a usable contact of the company or of its decision maker."""
    shown = lambda f: display_value(p[f]) != EMPTY_LABEL
    company = contacts.valid_email(p["email"]).isNotNull() | contacts.valid_phone(p["phone"]).isNotNull() | shown("linkedInUrl") | shown("xUrl")
    person = contacts.personal_email(p["decisionMakerEmail"], p["email"]).isNotNull() | contacts.valid_phone(p["decisionMakerPhone"]).isNotNull()
    person |= js_trim(F.coalesce(p["decisionMakerLinkedInUrl"], F.lit(""))) != ""
    return F.coalesce(p.isNotNull() & (company | (shown("decisionMaker") & person)), F.lit(False))


@bound
def recipient(p: Column, channel: Column) -> Column:
    """(toAddress, toName, toEmail) for the channel, or null."""
    name = F.when(~is_unknown(p["decisionMaker"]), js_trim(p["decisionMaker"]))
    email = F.coalesce(contacts.personal_email(p["decisionMakerEmail"], p["email"]), contacts.valid_email(p["email"]))
    phone = F.coalesce(contacts.e164_phone(p["decisionMakerPhone"]), contacts.e164_phone(p["phone"]))
    url = js_trim(p["decisionMakerLinkedInUrl"])
    link = F.when(is_personal_profile(url), url)
    address = F.when(channel == "EMAIL", email).when(channel == "WHATSAPP", phone).when(channel == "LINKEDIN", link)
    return F.when(address.isNotNull(), F.struct(address.alias("toAddress"), name.alias("toName"), F.when(channel == "EMAIL", email).alias("toEmail")))


def industry_groups(industry: Column) -> Column:
    """the synonym groups that hold the term."""
    term = F.lower(js_trim(industry))
    return F.filter(F.array(*[F.when(term.isin(terms), name) for name, terms in INDUSTRY_GROUPS.items()]), lambda x: x.isNotNull())


def shares_industry_group(a: Column, b: Column) -> Column:
    return F.arrays_overlap(industry_groups(a), industry_groups(b))


@bound
def profile_errors(p: Column) -> Column:
    """V1: the fields that break the profile's rules, as an array."""
    most = {"companyName": 500, "description": 2000, "industry": 200, "estimatedCompanySize": 50, "decisionMaker": 500, "revenue": 200}
    bad = {f: ~F.coalesce(F.length(js_trim(p[f])).between(1, n), F.lit(f in ("decisionMaker", "revenue"))) for f, n in most.items()}
    bad["estimatedCompanySize"] |= ~F.coalesce(F.lower(js_trim(p["estimatedCompanySize"])).rlike(EMPLOYEE_RANGE), F.lit(False))
    for f in LISTS:
        bad[f] = F.coalesce((F.size(p[f]) > 20) | F.exists(p[f], lambda v: ~F.length(v).between(1, 200)), F.lit(False))
    return F.filter(F.array(*[F.when(x, f) for f, x in bad.items()]), lambda x: x.isNotNull())


def query_errors(industry: Column, location: Column, employees: Column) -> Column:
    """V2: the fields of a parsed query that break its rules."""
    long = lambda x, n: ~F.coalesce(F.length(x).between(1, n), F.lit(False))
    bad = {"industry": long(industry, 200), "location": long(location, 200), "employeeRange": long(employees, 50) | ~F.coalesce(F.lower(js_trim(employees)).rlike(EMPLOYEE_RANGE), F.lit(False))}
    return F.filter(F.array(*[F.when(x, f) for f, x in bad.items()]), lambda x: x.isNotNull())


def campaign_errors(name: Column, channel: Column, subject: Column, body_html: Column, body_text: Column) -> Column:
    """V3: the fields of a new campaign that break its rules."""
    blank = lambda x: js_trim(F.coalesce(x, F.lit(""))) == ""
    bad = {
        "name": ~F.coalesce(F.length(name).between(1, 200), F.lit(False)),
        "subject": ((channel == "EMAIL") & blank(subject)) | (F.coalesce(F.length(subject), F.lit(0)) > 500),
        "bodyText": F.coalesce(F.length(body_text), F.lit(0)) == 0,
        "bodyHtml": (channel == "EMAIL") & blank(body_html) & blank(body_text),
    }
    return F.filter(F.array(*[F.when(x, f) for f, x in bad.items()]), lambda x: x.isNotNull())


def message_errors(channel: Column, subject: Column, body_text: Column) -> Column:
    """V4: a body of one character or more and a subject of 500 at most; e-mail
    needs a subject that isn't blank, other channels a body that isn't."""
    blank = lambda x: js_trim(F.coalesce(x, F.lit(""))) == ""
    bad = {
        "subject": ((channel == "EMAIL") & blank(subject)) | F.coalesce(F.length(subject) > 500, F.lit(False)),
        "bodyText": (F.coalesce(F.length(body_text), F.lit(0)) == 0) | ((channel != "EMAIL") & blank(body_text)),
    }
    return F.filter(F.array(*[F.when(x, f) for f, x in bad.items()]), lambda x: x.isNotNull())
