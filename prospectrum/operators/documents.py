"""Pages of HTML to text for a language model.

Python parses the tree of each page (a small helper, batch by batch); order
of lines, composition, budgets and statistics are Column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from prospectrum.constants import CRAWL_PATHS, EMAIL_PATTERN
from prospectrum.functions import contacts, markup, rules, urls
from prospectrum.functions.text import is_unknown, js_trim, without_runs
from prospectrum.operators.relational import budgeted_prefix

PARTS = pa.struct([
    ("title", pa.string()), ("description", pa.string()), ("language", pa.string()),
    ("headings", pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string())]))),
    ("json_ld", pa.list_(pa.string())), ("lines", pa.list_(pa.string())), ("blocks_removed", pa.int32()),
])
PARTS_DDL = "title string, description string, language string, headings array<struct<level:int,text:string>>, json_ld array<string>, lines array<string>, blocks_removed int"
MIN_QUALITY_CHARS, PAGE_CHARS, TOTAL_CHARS, PROXIMITY = 100, 8_000, 24_000, 300


def js_length(x: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int")


def parsed_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """The parts of each page beside its other columns; the page
    itself goes no further. A null page has empty parts."""
    rows = pages.select(html, *[c for c in pages.columns if c != html])
    schema = T.StructType([*rows.schema.fields[1:], *T.StructType.fromDDL(PARTS_DDL).fields])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                found_parts = []
                for text in part.column(0):
                    found = markup.page_parts(text.as_py() or "")
                    found["headings"] = [{"level": n, "text": t} for n, t in found["headings"]]
                    found_parts.append(found)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *pa.array(found_parts, PARTS).flatten()], names=schema.names)

    return rows.mapInArrow(parse, schema)


def composed(url: Column, path: Column, title: Column) -> Column:
    """The sections of a page's document, before its budget."""
    none = F.array().cast("array<string>")
    heads = F.transform("headings", lambda h: F.concat(F.repeat(F.lit("#"), h["level"]), F.lit(" "), h["text"]))
    body = js_trim(F.array_join(without_runs(F.col("lines")), "\n"))
    sections = F.concat(
        F.array(F.concat(F.lit("--- PAGE: "), path, F.lit(" ---")), F.concat(F.lit("URL: "), url)),
        F.when(F.coalesce(title, F.lit("")) != "", F.array(F.concat(F.lit("TITLE: "), title))).otherwise(none),
        F.when(F.coalesce("description", F.lit("")) != "", F.array(F.concat(F.lit("DESCRIPTION: "), "description"))).otherwise(none),
        F.when(F.size("headings") > 0, F.concat(F.array(F.lit(""), F.lit("HEADINGS:")), heads)).otherwise(none),
        F.array(F.lit(""), F.lit("CONTENT:"), body),
        F.when(F.size("json_ld") > 0, F.concat(F.array(F.lit(""), F.lit("STRUCTURED DATA:")), F.col("json_ld"))).otherwise(none),
    )
    return F.array_join(sections, "\n")


def within_budget(body: Column, most: int) -> Column:
    """What follows the content mark is cut; what stands before stays."""
    mark = "\nCONTENT:\n"
    at = F.instr(body, mark)
    head = F.substring(body, F.lit(1), at + len(mark) - 1)
    left = F.greatest(F.lit(most) - F.length(head), F.lit(0))
    cut = F.concat(head, F.substring(body, F.length(head) + 1, left))
    return F.when(F.length(body) <= most, body).when(at == 0, F.substring(body, 1, most)).otherwise(cut)


def clean_pages(pages: DataFrame, key: str = "page_id", most: int = PAGE_CHARS) -> DataFrame:
    """Document, metadata and statistics of each page.

    pages: key, url, html, and perhaps title and page_path. Pages that break
    the input rules are not cleaned, and results that break the output rules are left out; ``rejected_pages`` has both.
    """
    good = (F.size("__in") == 0) & (F.size("__bad") == 0)
    return _cleaned(pages, key, most).where(good).drop("__in", "__bad")


def _checked(pages: DataFrame) -> DataFrame:
    """pages with their path (``__path``) and the input rules they break (``__bad``)."""
    own = [F.col("page_path").alias("__path")] if "page_path" in pages.columns else [F.coalesce(F.nullif(F.col("__site.path"), F.lit("")), F.lit("/")).alias("__path")]
    title = F.col("title") if "title" in pages.columns else F.lit(None).cast("string")
    found = pages.withColumn("__site", urls.parsed("url")).select("*", *own)
    no_url = rules.not_between(F.col("url"), 1, rules.URL_CHARS) | F.col("__site").isNull()
    return found.withColumn("__bad", rules.cleaning_errors(F.col("html"), no_url, F.col("__path"), title)).drop("__site")


def _cleaned(pages: DataFrame, key: str, most: int) -> DataFrame:
    """Every page, cleaned if it may be, with the input rules (``__in``) and the
    output rules (``__bad``) that it breaks. Each is checked and parsed once."""
    title = F.col("given_title") if "title" in pages.columns else F.lit(None).cast("string")
    path, good = F.col("__path"), F.size("__bad") == 0
    source = _checked(pages).select(key, F.when(good, F.col("html")).alias("html"), "url", F.when(good, F.octet_length("html")).alias("input_bytes"), path.alias("path"), F.col("__bad").alias("__in"), *([F.col("title").alias("given_title")] if "title" in pages.columns else []))
    whole = parsed_pages(source).withColumn("title", F.coalesce(F.when(js_trim(title) != "", js_trim(title)), "title"))
    whole = whole.withColumn("body", within_budget(composed(F.col("url"), F.col("path"), F.col("title")), most))
    chars = js_length(F.col("body"))
    return whole.withColumn("__bad", F.when(F.size("__in") == 0, rules.cleaned_errors(F.col("body"), F.col("headings")))).select(
        key, "url", "path", "title", "description", "language", "headings", "json_ld", "body", "input_bytes", chars.alias("output_chars"),
        F.when(F.col("input_bytes") > 0, chars / F.col("input_bytes")).otherwise(0.0).alias("compression_ratio"), "blocks_removed",
        F.size("headings").alias("sections_preserved"), (chars < MIN_QUALITY_CHARS).alias("low_quality"), "__in", "__bad",
    )


def judged_pages(pages: DataFrame, key: str = "page_id", most: int = PAGE_CHARS) -> DataFrame:
    """Every page with its code and message: it breaks the input rules
    (INVALID_INPUT), its result breaks the output rules (CLEANING_FAILED), or it
    is CLEANED and there is no message."""
    message = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("invalid "), x)), "; ")
    code = F.when(F.size("__in") > 0, "INVALID_INPUT").when(F.size("__bad") > 0, "CLEANING_FAILED").otherwise("CLEANED")
    return _cleaned(pages, key, most).select(key, code.alias("code"), message(F.when(F.size("__in") > 0, F.col("__in")).otherwise(F.col("__bad"))).alias("message"))


def rejected_pages(pages: DataFrame, key: str = "page_id", most: int = PAGE_CHARS) -> DataFrame:
    """Pages that break the input rules (INVALID_INPUT) and results that
    break the output rules (CLEANING_FAILED), each with its message."""
    return judged_pages(pages, key, most).where("code <> 'CLEANED'")


def company_documents(pages: DataFrame, company: str, position: str, most: int = TOTAL_CHARS) -> DataFrame:
    """Each company's pages as one document. Over budget, pages
    go by path priority, and the first that doesn't fit ends the document."""
    sized = pages.withColumns({"__n": F.length("body"), "__order": F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, CRAWL_PATHS)), F.col("path")), F.lit(0)), F.lit(99))})
    whole = (F.sum("__n").over(Window.partitionBy(company)) + 2 * (F.count("*").over(Window.partitionBy(company)) - 1)) <= most
    sized = sized.withColumn("__whole", whole)
    cut = budgeted_prefix(sized.where("not __whole"), company, [F.col("__order"), F.col(position)], "__n", most)
    taken = sized.where("__whole").withColumn("__order", F.lit(0)).unionByName(cut)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__order", position, "body"))), lambda x: x["body"]), "\n\n")
    return taken.groupBy(company).agg(joined.alias("document"), F.count("*").alias("pages"))


_MAILTO = re.compile(f"mailto:({EMAIL_PATTERN})", re.IGNORECASE)
_PROFILE = re.compile(r"https?://(?:[\w.-]+\.)?linkedin\.com/in/[a-z0-9_-]+/?", re.IGNORECASE | re.ASCII)


def _near(html: str, name: str) -> tuple[list[str], list[str]]:
    tokens = [t for t in re.split(r"[\s-]+", name.split(",")[0].lower()) if len(t) >= 2]
    close = lambda m: any(t in html[max(0, m.start() - PROXIMITY) : m.start()].lower() for t in tokens)
    return [m[1].lower() for m in _MAILTO.finditer(html) if close(m)], [m[0] for m in _PROFILE.finditer(html) if close(m)]


def contact_hints(pages: DataFrame, key: str, html: str = "html", name: str = "decision_maker") -> DataFrame:
    """the addresses and profiles within 300 characters after a name."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [_near(h.as_py() or "", n.as_py() or "") for h, n in zip(batch.column(1), batch.column(2), strict=True)]
            emails, links = ([list(x) for x in zip(*pairs, strict=True)] if pairs else ([], []))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(emails, pa.list_(pa.string())), pa.array(links, pa.list_(pa.string()))], names=[key, "emails", "links"])

    kind = pages.schema[key].dataType.simpleString()
    known = pages.select(key, html, F.when(is_unknown(name), "").otherwise(F.col(name)).alias(name))
    found = known.mapInArrow(find, f"{key} {kind}, emails array<string>, links array<string>")
    own = F.get(F.filter("emails", lambda e: ~contacts.is_generic_local_part(e)), F.lit(0))
    return found.select(key, contacts.valid_email(own).alias("email"), F.get("links", F.lit(0)).alias("linkedin_url"))


def first_hints(hints: DataFrame, company: str, position: str) -> DataFrame:
    """the first non-null hint of each kind, in page order."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(position))).alias(c)
    return hints.groupBy(company).agg(first("email"), first("linkedin_url"))
