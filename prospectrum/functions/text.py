"""String helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prospectrum.constants import EMPTY_LABEL, INJECTION_PATTERNS

#: White space as ECMAScript has it, for trim and \s.
SPACE = "[\\u0009-\\u000D\\u0020\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, then) -> Column:
    """then(value), with value computed once however often then uses it.
    (Written out, an expression is repeated in the plan at every use.)"""
    return F.get(F.transform(F.array(value), then), F.lit(0))


#: The characters of that class.
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def js_trim(x: Column | str) -> Column:
    return F.btrim(col(x), F.lit(_SPACES))


def squeezed(x: Column | str) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(col(x), f"{SPACE}+", " "))


def is_unknown(x: Column | str) -> Column:
    return F.lower(js_trim(F.coalesce(col(x), F.lit("")))).isin("", "unknown")


def display_value(x: Column | str) -> Column:
    """F8: null, blank and unknown become a dash."""
    return F.when(is_unknown(x), EMPTY_LABEL).otherwise(js_trim(x))


def title_case(x: Column | str) -> Column:
    """First letters up; what follows keeps its case."""
    part = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))
    return F.array_join(F.transform(F.split(col(x), f"{SPACE}+"), part), " ")


def location_label(city: Column | str, country: Column | str, criteria: Column | str) -> Column:
    """city and country, either, the search's location, or a dash."""
    a, b, c = display_value(city), display_value(country), col(criteria)
    return (
        F.when((a != EMPTY_LABEL) & (b != EMPTY_LABEL), F.concat(title_case(a), F.lit(", "), title_case(b)))
        .when(a != EMPTY_LABEL, title_case(a))
        .when(b != EMPTY_LABEL, title_case(b))
        .when((F.coalesce(c, F.lit("")) != "") & (c != "unknown"), title_case(c))
        .otherwise(EMPTY_LABEL)
    )


def display_name(profile_name: Column | str, company_name: Column | str, domain: Column | str) -> Column:
    """the first that isn't null; an empty name counts."""
    return F.coalesce(col(profile_name), col(company_name), col(domain))


def status_label(x: Column | str) -> Column:
    """FOO_BAR to Foo Bar."""
    return F.initcap(F.lower(F.replace(col(x), F.lit("_"), F.lit(" "))))


def organization_slug(x: Column | str) -> Column:
    """lower-case letters and digits joined by dashes, 100 at most."""
    dashed = F.regexp_replace(js_trim(F.lower(col(x))), "[^a-z0-9]+", "-")
    slug = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 100)
    return F.when(slug == "", "organization").otherwise(slug)


def slug_candidates(slug: Column | str) -> Column:
    """the slug, then with -2 to -50, cut to 100."""
    numbered = F.transform(
        F.sequence(F.lit(2), F.lit(50)),
        lambda n: F.concat(F.left(col(slug), 99 - F.length(n.cast("string"))), F.lit("-"), n.cast("string")),
    )
    return F.concat(F.array(col(slug)), numbered)


def escaped_html(x: Column | str) -> Column:
    out = col(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def body_html(x: Column | str) -> Column:
    """paragraphs at blank lines, escaped and wrapped."""
    paragraphs = F.filter(F.transform(F.split(col(x), f"\\n{SPACE}*\\n"), js_trim), lambda p: p != "")
    wrapped = F.array_join(F.transform(paragraphs, lambda p: F.concat(F.lit("<p>"), escaped_html(p), F.lit("</p>"))), "")
    return F.when(F.size(paragraphs) == 0, F.concat(F.lit("<p>"), escaped_html(js_trim(x)), F.lit("</p>"))).otherwise(wrapped)


def prompt_literal(x: Column | str) -> Column:
    """backslashes and quotes escaped, controls to spaces, NUL dropped."""
    out = F.replace(F.replace(col(x), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.regexp_replace(F.regexp_replace(out, "\\x00", ""), "[\\x01-\\x1f\\x7f-\\x9f]", " ")


def without_injections(x: Column | str) -> Column:
    """the first match of each pattern goes; then runs of quotes shrink."""
    out = col(x)
    for pattern in INJECTION_PATTERNS:
        out = F.regexp_replace(out, f"(?is)\\A(.*?)(?:{pattern.replace(chr(92) + 's', SPACE)})", "$1[filtered]")
    return F.regexp_replace(out, '"{3,}', '""')


def untrusted(label: str, x: Column | str) -> Column:
    return F.concat(F.lit(f"<untrusted_{label}>\n"), without_injections(js_trim(x)), F.lit(f"\n</untrusted_{label}>"))


def prompt_content(x: Column | str, most: int = 24_000) -> Column:
    """sanitised, then cut."""
    return F.substring(without_injections(x), 1, most)


def distinct_strings(x: Column) -> Column:
    """Trimmed, blanks dropped, the first spelling of each word kept.

    Words meet their equals in a sort, so that a long list takes no square of steps.
    """
    trimmed = F.filter(F.transform(x, js_trim), lambda v: v != "")
    keyed = F.array_sort(F.transform(trimmed, lambda v, i: F.struct(F.lower(v).alias("k"), i.alias("i"), v.alias("v"))))
    first = lambda s: F.filter(s, lambda y, i: (i == 0) | (y["k"] != F.get(s, i - 1)["k"]))
    back = F.array_sort(F.transform(let(keyed, first), lambda y: F.struct(y["i"].alias("i"), y["v"].alias("v"))))
    return F.transform(back, lambda y: y["v"])


def without_runs(lines: Column) -> Column:
    """Lines that equal the one before go."""
    return F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, i - 1)))


def stripped_html(x: Column | str, most: int = 500_000) -> Column:
    """F16: no script, style and noscript blocks."""
    out = col(x)
    for tag in ("script", "style", "noscript"):
        out = F.regexp_replace(out, f"(?is)<{tag}\\b[^>]*>.*?</{tag}>", "")
    return F.substring(out, 1, most)


def visible_text(x: Column | str, most: int = 50_000) -> Column:
    return F.substring(squeezed(x), 1, most)


def percent_label(x: Column | str) -> Column:
    """a share as a whole percentage, or a dash."""
    return F.when(col(x).isNull(), EMPTY_LABEL).otherwise(F.concat(F.floor(col(x) * 100 + 0.5).cast("string"), F.lit("%")))


def content_hash(x: Column | str) -> Column:
    return F.sha2(col(x), 256)


def profile_hash(profile: Column) -> Column:
    """sixteen hex digits over the profile as JSON, nulls kept."""
    return F.substring(F.sha2(F.to_json(profile, {"ignoreNullFields": "false"}), 256), 1, 16)
