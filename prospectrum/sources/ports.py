"""What lies outside Spark (web pages, language models) as injected functions.

A port is a plain function that is safe to repeat; executors call it for each
row, batch by batch. Tests pass functions that answer from recorded values.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectrum.functions import rules
from prospectrum.functions.profiles import EMPLOYEE_RANGE, PROFILE, message_errors, profile_errors
from prospectrum.functions.text import col, js_trim, prompt_literal
from prospectrum.streaming.machines import RobotsCache


def retried(call: Callable, attempts: int = 3, delay_ms: int = 500, growth: str = "exponential", again: Callable[[Exception], bool] | None = None, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """Calls again after an error. Delays double, or grow by one step."""

    def run(*args):
        for attempt in range(1, attempts + 1):
            try:
                return call(*args)
            except Exception as error:
                if attempt == attempts or (again is not None and not again(error)):
                    raise
                sleep(delay_ms / 1000 * (2 ** (attempt - 1) if growth == "exponential" else attempt))

    return run


def is_retryable_status(status: Column | str) -> Column:
    return col(status).isin(408, 429) | (col(status) >= 500)


def answered(rows: DataFrame, port: Callable[[dict], object], out: str = "answer") -> DataFrame:
    """Rows with the port's answer as JSON text, and its error if any."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            answers, errors = [], []
            for row in part.astype(object).where(part.notna(), None).to_dict("records"):
                try:
                    answers.append(json.dumps(port(row)))
                    errors.append(None)
                except Exception as error:
                    answers.append(None)
                    errors.append(str(error) or type(error).__name__)
            yield part.assign(**{out: pd.Series(answers, part.index, dtype=object), "error": pd.Series(errors, part.index, dtype=object)})

    return rows.mapInPandas(ask, f"{kinds}, `{out}` string, error string")


def crawled(companies: DataFrame, targets: Column, get: Callable[[str], str], allowed: Column | None = None) -> DataFrame:
    """A row for each target page that robots rules allow, with html or error.

    targets: an array of (path, url); allowed: a test of column ``path``.
    """
    each = companies.withColumn("target", F.explode(targets)).select("*", "target.path", "target.url").drop("target")
    asked = each if allowed is None else each.where(allowed)
    found = answered(asked, lambda row: get(row["url"]), "html")
    return found.withColumn("html", F.from_json(F.concat(F.lit('{"x":'), "html", F.lit("}")), "x string")["x"])


def company_crawls(companies: DataFrame, targets: Column, get: Callable[[str], str], limit_ms: int = 120_000, clock: Callable[[], float] = time.monotonic, robots: Callable[[str], tuple[int, str]] | None = None, agent: str = "") -> DataFrame:
    """Each company's pages (path, url, html, error) from one visit, with
    pages_attempted, pages_succeeded and status: success, partial or failed. A
    page counts if it came without an error and with text. A visit that takes
    longer than limit_ms is given up as a whole: its error says so, no page is
    kept, and the status is failed.

    robots: an origin to the (status, text) of its robots.txt, kept for an hour
    (``RobotsCache``); a page that the rules for ``agent`` forbid fails unread."""

    def visit(row: dict) -> list[dict]:
        began, pages = clock(), []
        gate = RobotsCache(robots, agent, clock) if robots is not None else None
        for target in json.loads(row["__targets"]):
            try:
                if gate is not None and not gate.allows("/".join(target["url"].split("/", 3)[:3]), target["path"]):
                    raise PermissionError("Blocked by robots.txt")
                pages.append(target | {"html": get(target["url"])})
            except Exception as error:
                pages.append(target | {"error": str(error) or type(error).__name__})
            if (clock() - began) * 1000 > limit_ms:
                raise TimeoutError(f"Company crawl exceeded {limit_ms}ms")
        return pages

    found = answered(companies.withColumn("__targets", F.to_json(targets)), visit, "__pages")
    pages = F.coalesce(F.from_json("__pages", "array<struct<path:string,url:string,html:string,error:string>>"), F.expr("array()").cast("array<struct<path:string,url:string,html:string,error:string>>"))
    seen = found.withColumn("pages", pages).drop("__pages", "__targets")
    good = F.size(F.filter("pages", lambda p: p["error"].isNull() & (F.coalesce(F.length(p["html"]), F.lit(0)) > 0)))
    status = F.when(good == 0, "failed").when(good == F.size("pages"), "success").otherwise("partial")
    return seen.withColumns({"pages_attempted": F.size("pages"), "pages_succeeded": good, "status": status})


def checked(rows: DataFrame, port: Callable[[dict], object], kind: str, errors: Callable[[Column], Column], entering: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows with the port's answer as a struct ``value`` of the kind (DDL),
    or with a code and no value: PROVIDER_ERROR (``error`` says which),
    EMPTY_RESPONSE, or VALIDATION_ERROR (``broken`` names the fields).
    entering: what is done to a value before it is checked."""
    found = answered(rows, port, "__answer")
    value = F.from_json("__answer", kind)
    read = found.withColumn("value", value if entering is None else entering(value))
    read = read.withColumn("broken", errors(F.col("value")))
    empty = F.coalesce(F.col("__answer").isin("null", '""', "{}", "[]"), F.lit(True))
    code = F.when(F.col("error").isNotNull(), "PROVIDER_ERROR").when(empty, "EMPTY_RESPONSE").when(F.size("broken") > 0, "VALIDATION_ERROR")
    read = read.withColumn("code", code).drop("__answer")
    return read.withColumns({"value": F.when(F.col("code").isNull(), F.col("value")), "broken": F.when(F.col("code") == "VALIDATION_ERROR", F.col("broken"))})


def extracted(rows: DataFrame, port: Callable[[dict], dict]) -> DataFrame:
    """A company's profile from its pages' text."""
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PROFILE)
    return checked(rows, port, kind, profile_errors, rules.normalized_profile)


def detected_signals(rows: DataFrame, port: Callable[[dict], dict]) -> DataFrame:
    """Buying signals of a company."""
    return checked(rows, port, "signals array<struct<type:string,title:string,summary:string,sourceUrl:string,confidence:double>>", lambda v: rules.intent_errors(v["signals"]))


def written_messages(rows: DataFrame, port: Callable[[dict], dict], channel: Column | str = "channel") -> DataFrame:
    """A message for the row's channel."""
    return checked(rows, port, "subject string, bodyText string", lambda v: message_errors(col(channel), v["subject"], v["bodyText"]))


def prompt(template: str, **values: Column | str) -> Column:
    """A template whose {{name}} marks are filled with escaped values."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{{{name}}}}}"), F.coalesce(prompt_literal(value), F.lit("")))
    return out


def parsed_queries(jobs: DataFrame, parse: Callable[[dict], dict], query: str = "query") -> DataFrame:
    """Jobs with criteria (industry, location, employeeRange).

    A criterion that is missing, blank or malformed is 'unknown'.
    """
    found = answered(jobs, parse, "__answer")
    x = F.from_json("__answer", "industry string, location string, employeeRange string")
    text = lambda c: F.when(js_trim(c).isNotNull() & (js_trim(c) != ""), F.substring(js_trim(c), 1, 200)).otherwise("unknown")
    size = F.lower(js_trim(x["employeeRange"]))
    criteria = F.struct(F.lower(text(x["industry"])).alias("industry"), text(x["location"]).alias("location"), F.when(size.rlike(EMPLOYEE_RANGE), size).otherwise("unknown").alias("employeeRange"))
    return found.withColumn("criteria", criteria).drop("__answer")


def has_parsed_criteria(criteria: Column | str) -> Column:
    """all three keys are there; values may be null."""
    keys = F.json_object_keys(col(criteria))
    return F.coalesce(F.array_contains(keys, "industry") & F.array_contains(keys, "location") & F.array_contains(keys, "employeeRange"), F.lit(False))


def is_parsed_query(criteria: Column | str) -> Column:
    """the looser test, of the first key alone."""
    return F.coalesce(F.array_contains(F.json_object_keys(col(criteria)), "industry"), F.lit(False))
