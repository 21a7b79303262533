"""The address parser against made-up addresses whose parts are known."""

from __future__ import annotations

import random
import re

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prospectrum.functions import urls, weburl
from prospectrum.operators import entity

HOSTS = [
    ("acme.fi", "acme.fi"), ("WWW.Acme.FI", "www.acme.fi"), ("a_b.acme.fi", "a_b.acme.fi"), ("müller.fi", "xn--mller-kva.fi"), ("BÜCHER.example", "xn--bcher-kva.example"), ("a%2Db.fi", "a-b.fi"),
    ("例え.jp", "xn--r8jz45g.jp"), ("faß.de", "xn--fa-hia.de"), ("acme。fi", "acme.fi"), ("ａｃｍｅ.fi", "acme.fi"), ("so\u00adft.fi", "soft.fi"), ("xn--mller-kva.fi", "xn--mller-kva.fi"),
    ("0x7f.1", "127.0.0.1"), ("010.1.2.3", "8.1.2.3"), ("3232235777", "192.168.1.1"), ("1.2.3.4.", "1.2.3.4"), ("0x1.0y", "0x1.0y"), ("[::1]", "[::1]"), ("[1:0:0:2:0:0:0:3]", "[1:0:0:2::3]"), ("[::FFFF:1.2.3.4]", "[::ffff:102:304]"),
    *[(x, None) for x in ("", "a b.fi", "a<b.fi", "a^b.fi", "a|b.fi", "a%00b.fi", "1.2.3.256", "1.2.3.4.5", "a.09", "[::1", "[1::2::3]", "[::1%25eth0]", "xn--a.fi", "xn--", "℀.fi", "\u0301a.fi", "a\ufffd.fi", "%ff.fi")],
]
#: Segments of a path and what becomes of them: a text, or up (-1) or stay (0).
SEGMENTS = [("a", "a"), ("x y", "x%20y"), ("ü", "%C3%BC"), ("a|b", "a|b"), ("%7Ea", "%7Ea"), ("{q}", "%7Bq%7D"), ('"', "%22"), ("@:!$&'()*+,;=", "@:!$&'()*+,;="), ("", ""), ("..", -1), (".", 0), ("%2E", 0), (".%2e", -1), ("...", "..."), ("🙂", "%F0%9F%99%82")]
USERS = [("", ""), ("u@", "u@"), ("u:p@", "u:p@"), ("u:@", "u@"), (":p@", ":p@"), ("@", ""), ("a@b:c:d@", "a%40b:c%3Ad@"), ("ü;=@", "%C3%BC%3B%3D@")]
PORTS = [("", ""), (":", ""), (":8080", ":8080"), (":00443", ":443"), (":65535", ":65535"), (":65536", None), (":x", None), (":-1", None)]


def made(rng: random.Random) -> tuple[str, str | None, str | None]:
    """An address, its domain and its website."""
    scheme, usual = rng.choice([("http", "80"), ("https", "443"), ("HTTPS", "443"), ("ftp", "21")])
    (host, want_host), (user, want_user), (port, want_port) = rng.choice(HOSTS), rng.choice(USERS), rng.choice(PORTS)
    back = rng.random() < 0.2
    slashes = "://" + ("" if rng.random() < 0.8 else "//")
    taken = [rng.choice(SEGMENTS) for _ in range(rng.randrange(5) if host else 0)]
    path, out = "", []
    for i, (written, means) in enumerate(taken):
        path += ("\\" if back else "/") + written
        if isinstance(means, str):
            out.append(means)
        else:
            out = out[:-1] if means else out
            if i == len(taken) - 1:
                out.append("")
    text = scheme + slashes + user + host + port + path + rng.choice(["", "?q=/x#y", "#f?g", "?"])
    blank = rng.choice(["", " ", "\n\t", "\x00 "])
    text = blank + text + rng.choice(["", "  \r\n"])
    if rng.random() < 0.1:
        text = text.replace("/x", "/\tx")
    if want_host is None or want_port is None:
        return text, None, None
    name = want_host.removeprefix("www.")
    port = "" if want_port == ":" + usual else want_port
    whole = f"{scheme.lower()}://{want_user}{name}{port}/{'/'.join(out)}"
    return text, name if "." in name else None, None if scheme == "ftp" else whole.removesuffix("/")


def test_made_up_addresses():
    rng = random.Random(7)
    for _ in range(20_000):
        text, domain, website = made(rng)
        assert (weburl.domain(text), weburl.website(text)) == (domain, website), text


@pytest.mark.parametrize("text", ["", " ", "://", "http://", "https://?x", "https://#", "https:///", "http://user@/", "http://:80/", "1http://a.b", "a.b?u=http://c.d", "javascript://"])
def test_texts_that_have_no_domain(text):
    assert weburl.domain(text) is None


def test_other_schemes():
    assert weburl.domain("foo://A.B:70/c") == "a.b" and weburl.parse("foo://A.B:70/c").origin == "foo://A.B:70"
    assert weburl.domain("file://host.fi/x") == "host.fi" and weburl.domain("file:///c:/x://") is None and weburl.parse("file://C:/x/../y").path == "/C:/y"
    assert weburl.parse("mailto:x y").path == "x%20y" and weburl.parse("acme.fi") is None and weburl.website("foo://a.b") is None
    assert weburl.parse("https:acme.fi").host == "acme.fi" and weburl.parse("//acme.fi") is None


def test_a_second_look_changes_nothing():
    rng = random.Random(8)
    for _ in range(3000):
        website = weburl.website(made(rng)[0])
        if website and not website.endswith("/") and "www." not in website:
            assert weburl.website(website) == website


def test_each_spelling_of_a_candidate_s_website_is_parsed_once(spark, monkeypatch):
    rows = [(f"acme{i % 3}.fi{'/' * (i % 2)}", i % 10 / 10, i) for i in range(600)] + [(None, 0.5, 600), ("none", 0.5, 601)]
    seen = spark.sparkContext.accumulator(0)

    def counted(texts: pd.Series) -> pd.Series:
        seen.add(len(texts))
        return texts

    monkeypatch.setattr(entity, "site", lambda x: urls.site(F.pandas_udf(counted, "string").asNondeterministic()(x)))
    best = entity.dedup_candidates(spark.createDataFrame(rows, "website string, confidence double, ordinal long"))
    assert sorted((r.domain, r.website, r.ordinal) for r in best.collect()) == [("acme0.fi", "https://acme0.fi", 9), ("acme1.fi", "https://acme1.fi", 19), ("acme2.fi", "https://acme2.fi", 29)]
    assert seen.value == 8


def test_plain_addresses_are_read_as_the_parser_reads_them(monkeypatch):
    texts = ["acme.fi", "https://WWW.Acme.fi", "http://www.www.acme.fi/a.b/c/?q=http://x#y", "acme.fi/?u=http://x", "https://acme.fi//a/", "http://www.fi/", "a.xn--bcher-kva.fi/", "acme.fi/.a", "acme.fi./", "-a.b-.fi/~x/_/"]
    tables = [[complete(pa.array(texts)).to_pylist() for complete in (urls._site, urls._parsed)]]
    monkeypatch.setattr(weburl, "PLAIN", re.compile("(?!)"))
    assert tables == [[complete(pa.array(texts)).to_pylist() for complete in (urls._site, urls._parsed)]]
