"""E-mail addresses and phone numbers as Column expressions."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from prospectrum.constants import DIAL_CODES, GENERIC_LOCAL_PARTS, PLACEHOLDER_EMAIL_DOMAINS, PLACEHOLDER_PHONES
from prospectrum.functions.text import SPACE, col, js_trim, let

#: A conservative grammar: dotted atoms, a domain of labels, a letter ending.
EMAIL = "^(?!\\.)(?!.*\\.\\.)[a-z0-9_'+\\-.]*[a-z0-9_+\\-]@([a-z0-9][a-z0-9\\-]*\\.)+[a-z]{2,}$"


def valid_email(x: Column | str) -> Column:
    """the address in lower case, or null."""

    def checked(parts: Column) -> Column:
        local, domain = F.lower(js_trim(F.get(parts, F.lit(0)))), F.lower(js_trim(F.get(parts, F.lit(1))))
        address = F.concat(local, F.lit("@"), domain)
        return F.when((F.size(parts) == 2) & address.rlike(EMAIL) & ~domain.isin(PLACEHOLDER_EMAIL_DOMAINS), address)

    return let(F.split(js_trim(x), "@", -1), checked)


def is_generic_local_part(x: Column | str) -> Column:
    return F.lower(F.trim(F.get(F.split(col(x), "@"), F.lit(0)))).isin(GENERIC_LOCAL_PARTS)


def personal_email(x: Column | str, company: Column | str) -> Column:
    """valid, no generic inbox, not the company's own address."""
    own = valid_email(company)
    return let(valid_email(x), lambda e: F.when(~is_generic_local_part(e) & ~F.coalesce(e == own, F.lit(False)), e))


def phone_digits(x: Column | str) -> Column:
    """digits only, behind a plus sign if there was one."""
    trimmed = js_trim(x)
    digits = F.regexp_replace(trimmed, "[^0-9]", "")
    return F.when(trimmed.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)


def is_placeholder_digits(d: Column) -> Column:
    """listed, one digit only, a run up or down, one pair, or fictional."""
    run = lambda step: F.forall(F.sequence(F.lit(2), F.length(d)), lambda i: F.substring(d, i, F.lit(1)).cast("int") - F.substring(d, i - 1, F.lit(1)).cast("int") == step)
    runs = F.when(F.length(d) >= 7, run(1) | run(-1)).otherwise(False)
    return (d == "") | d.isin(PLACEHOLDER_PHONES) | d.rlike("^(\\d)\\1*$") | d.rlike("^(\\d\\d)\\1{3,}$") | d.rlike("^1?55501") | runs


def dial_code(d: Column) -> Column:
    """the first code of the list that leaves 6 to 12 digits, else null.
    Neighbours of one length in the list are looked up together, as a set."""
    heads = [(n, F.substring(d, 1, n).isin(list(codes)), F.substring(d, 1, n)) for n, codes in groupby(DIAL_CODES, len)]
    return F.coalesce(*[F.when(listed & (F.length(d) - n).between(6, 12), head) for n, listed, head in heads])


def _grouped(x: Column) -> Column:
    return F.rtrim(F.regexp_replace(x, "(.{1,3})", "$1 "))


def displayed_phone(x: Column | str) -> Column:
    """formatted input stays; else code and groups."""

    def shown(t: Column) -> Column:
        d = F.regexp_replace(t, "[^0-9]", "")

        def coded(code: Column) -> Column:
            n = F.substring(d, F.length(code) + 1, F.lit(20))
            finnish = F.regexp_replace(n, "^(\\d{2})(\\d{3})(\\d+)$", "$1 $2 $3")
            american = F.regexp_replace(n, "^(\\d{3})(\\d{3})(\\d{4})$", "($1) $2-$3")
            national = F.when((code == "358") & (F.length(n) == 9), finnish).when((code == "1") & (F.length(n) == 10), american).otherwise(_grouped(n))
            return F.when(code.isNotNull(), F.concat(F.lit("+"), code, F.lit(" "), national)).when(t.startswith("+"), t).otherwise(_grouped(d))

        return (
            F.when(t.rlike(f"{SPACE}|[().\\-]"), F.regexp_replace(t, f"{SPACE}+", " "))
            .when(F.length(d) < 7, t)
            .otherwise(let(dial_code(d), coded))
        )

    return let(js_trim(x), shown)


def valid_phone(x: Column | str) -> Column:
    """the number as displayed, or null."""

    def judged(t: Column, d: Column) -> Column:
        ok = t.rlike(f"^([+()0-9.\\-]|{SPACE})+$") & F.length(d).between(7, 15)
        ok &= F.when(t.startswith("+"), dial_code(d).isNotNull()).otherwise(F.length(d) <= 11)
        return F.when(F.when(ok, ~is_placeholder_digits(d)).otherwise(False), displayed_phone(t))

    return let(js_trim(x), lambda t: let(F.regexp_replace(t, "[^0-9]", ""), lambda d: judged(t, d)))


def e164_phone(x: Column | str) -> Column:
    """a valid number as plus and digits."""

    def plus(d: Column) -> Column:
        return F.when(d.startswith("+"), d).when(d != "", F.concat(F.lit("+"), d))

    return let(phone_digits(valid_phone(x)), plus)
