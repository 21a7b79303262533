"""Web addresses: parsed as browsers do in Arrow batches, judged as Column
expressions. Each step is bound with ``let``, so a plan holds it once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospectrum.constants import BLOCKED_DOMAINS, BLOCKED_HOSTS
from prospectrum.functions import weburl
from prospectrum.functions.text import col, let

_OCTETS = "^[0-9]{1,3}([.][0-9]{1,3}){3}$"


#: What is read from an address: null as a whole where a text is none. domain
#: and website are those of F1 and F2, site_domain is the F1 of that website.
SITE = T.StructType([T.StructField(n, T.StringType()) for n in ("scheme", "host", "origin", "path", "domain", "website", "site_domain")])


def _plain(scheme: str, host: str, path: str) -> tuple:
    """The row of an address in which nothing is left to decode."""
    bare = weburl.bare(host)
    below, dotted = weburl.bare(bare), lambda name: name if "." in name else None
    return scheme, host, f"{scheme}://{host}", path, dotted(bare), f"{scheme}://{bare}{path}".removesuffix("/"), dotted(below)


def _sites(texts: pa.Array, complete: Callable[[str], str]) -> pa.Array:
    """Each different text of a batch is parsed once; plain ones are just cut."""
    named = texts.dictionary_encode()
    rows = []
    for text in named.dictionary.to_pylist():
        found = weburl.PLAIN.fullmatch(text)
        if found and (found[1] or ("://" not in text and complete("") != "")) and "xn--" not in (host := found[2].lower()):
            rows.append(_plain(found[1] or "https", host, found[3] or "/"))
            continue
        url, website = weburl.parse(complete(text)), weburl.website(text)
        rows.append(url and (url.scheme, url.host, url.origin, url.path, weburl.domain(text), website, website and weburl.domain(website)))
    columns = [pa.array([r[i] if r else None for r in rows], pa.string()) for i in range(len(SITE))]
    parts = pa.StructArray.from_arrays(columns, SITE.names, mask=pa.array([r is None for r in rows], pa.bool_()))
    return parts.take(named.indices)


def _site(texts: pa.Array) -> pa.Array:
    return _sites(texts, weburl.with_scheme)


def _parsed(texts: pa.Array) -> pa.Array:
    return _sites(texts, str)


def site(x: Column | str) -> Column:
    """An address (``SITE``), with https:// put before a text that names no scheme.

    Said to be non-deterministic, so that the optimizer evaluates it once,
    not again in each filter and projection above.
    """
    return F.arrow_udf(_site, SITE).asNondeterministic()(col(x))


def parsed(x: Column | str) -> Column:
    """An absolute address (``SITE``); null for a text that is none."""
    return F.arrow_udf(_parsed, SITE).asNondeterministic()(col(x))


def normalized_domain(x: Column | str) -> Column:
    """the host in lower case without www., if it has a dot."""
    return site(x)["domain"]


def normalized_website(x: Column | str) -> Column:
    """http(s) only, no query, no fragment, no slash at the end."""
    return site(x)["website"]


def domain_of(website: Column | str) -> Column:
    """F1 of a website that is normalized already: read off, not parsed again."""
    host = F.regexp_extract(col(website), "^https?://(?:[^/@]*@)?(?:www[.])?([^/:]+)", 1)
    return F.when(F.contains(host, F.lit(".")), host)


def is_blocked_domain(domain: Column | str, blocked: list[str] = BLOCKED_DOMAINS) -> Column:
    """a blocked domain or one below it."""
    return F.lower(col(domain)).rlike(f"(^|[.])({'|'.join(map(re.escape, blocked))})$")


def is_private_ipv4(host: Column) -> Column:
    """four numbers of up to three digits, in a network for this host (0,
    127), link-local (169.254) or private use (10, 172.16 to 172.31, 192.168)."""

    def inside(octets: Column) -> Column:
        a, b = F.get(octets, F.lit(0)).cast("int"), F.get(octets, F.lit(1)).cast("int")
        return a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 192) & (b == 168)) | ((a == 172) & b.between(16, 31))

    return F.when(host.rlike(_OCTETS), let(F.split(host, "[.]"), inside)).when(host.isNotNull(), False)


def is_safe_host(host: Column | str, allowed: Column | str | None = None) -> Column:
    """no private or local host; equal to or below the allowed domain."""

    def safe(bare: Column) -> Column:
        good = ~(bare.isin(BLOCKED_HOSTS) | is_private_ipv4(bare) | bare.endswith(".local") | bare.endswith(".internal"))
        if allowed is None:
            return good
        below = lambda domain: (bare == domain) | F.endswith(bare, F.concat(F.lit("."), domain))
        return good & let(F.regexp_replace(F.lower(col(allowed)), "^www\\.", ""), below)

    return let(F.regexp_replace(F.lower(col(host)), "^www\\.", ""), safe)


def is_safe_url(url: Column | str, allowed: Column | str | None = None) -> Column:
    return let(parsed(url), lambda u: F.coalesce(u["scheme"].isin("http", "https") & is_safe_host(u["host"], allowed), F.lit(False)))


def crawl_targets(website: Column | str, domain: Column | str, paths: list[str]) -> Column:
    """(path, url) for each path, where the site's host is safe."""

    def targets(base: Column) -> Column:
        each = F.array(*[F.struct(F.lit(p).alias("path"), F.concat(base["origin"], F.lit(p)).alias("url")) for p in paths])
        good = base["scheme"].isin("http", "https") & is_safe_host(base["host"], domain)
        return F.when(F.coalesce(good, F.lit(False)), each)

    return let(parsed(normalized_website(website)), targets)


def robots_allows(rules: Column | str, path: Column | str, agent: str) -> Column:
    """Disallow prefixes of groups for * or the agent (in lower case). A null file forbids."""
    lines = F.transform(F.split(col(rules), "\n"), lambda x: F.trim(F.regexp_replace(x, "\\r", "")))
    value = lambda x: F.trim(F.coalesce(F.get(F.split(x, ":"), F.lit(1)), F.lit("")))
    start = F.struct(F.lit(False).alias("applies"), F.lit(True).alias("allowed"))

    def step(state: Column, line: Column) -> Column:
        is_agent, name = F.lower(line).startswith("user-agent:"), F.lower(value(line))
        hit = state["applies"] & F.lower(line).startswith("disallow:") & (value(line) != "") & F.startswith(col(path), value(line))
        return F.struct(
            F.when(is_agent, (name == "*") | F.contains(name, F.lit(agent))).otherwise(state["applies"]).alias("applies"),
            (state["allowed"] & (is_agent | ~hit)).alias("allowed"),
        )

    return F.coalesce(F.aggregate(lines, start, step)["allowed"], F.lit(False))


def website_label(url: Column | str) -> Column:
    """host without www., the text itself if it is no URL."""
    host = F.regexp_replace(F.try_parse_url(col(url), F.lit("HOST")), "^www\\.", "")
    return F.when(F.coalesce(col(url), F.lit("")) == "", "—").otherwise(F.coalesce(host, col(url)))


def is_personal_profile(url: Column | str) -> Column:
    """a path below /in/, whatever the host."""
    return F.coalesce(F.lower(F.try_parse_url(F.trim(col(url)), F.lit("PATH"))).startswith("/in/"), F.lit(False))


def is_company_page(url: Column | str) -> Column:
    return F.coalesce(F.contains(F.lower(F.try_parse_url(col(url), F.lit("PATH"))), F.lit("/company/")), F.lit(False))
