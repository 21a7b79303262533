"""Reference-shaped views over the supplied tables.

Each view is one SELECT that Spark and DuckDB both run, so that a query and
its oracle start from the same rows. Braces name tables or other views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from prospectrum.constants import RECIPIENT_STATUS, STAGES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _pick(number: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE CAST({number} AS INT) {whens} END"


VIEWS = {
    "campaigns": """
        SELECT o_orderkey AS campaign_id, concat('Campaign ', CAST(o_orderkey AS STRING)) AS name, o_custkey AS user_id, c_nationkey AS organization_id,
          CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'WHATSAPP' ELSE 'LINKEDIN' END AS channel,
          CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'COMPLETED' ELSE 'DRAFT' END AS status, CAST(o_orderdate AS DATE) AS created_on
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "recipients": f"""
        SELECT l_orderkey AS campaign_id, l_suppkey AS company_id, l_partkey AS part_id, l_linenumber AS line,
          {_pick("(l_partkey + l_linenumber) % 9", RECIPIENT_STATUS)} AS status, CAST(l_shipdate AS DATE) AS created_on FROM {{lineitem}}""",
    "companies": """
        SELECT s_suppkey AS company_id, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_name END AS name,
          concat('supplier', CAST(s_suppkey AS STRING), '.fi') AS domain, CAST(s_suppkey % 13 AS INT) AS updated_day,
          CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(s_suppkey % 31 AS INT) END AS crawled_day, s_nationkey AS nation_id FROM {supplier}""",
    "profiles": """
        SELECT p_partkey % (SELECT count(*) FROM {supplier}) AS company_id, lower(p_type) AS industry,
          CAST(row_number() OVER (PARTITION BY p_partkey % (SELECT count(*) FROM {supplier}) ORDER BY p_partkey) AS INT) AS version,
          p_size / 50.0E0 AS completeness, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat(CASE WHEN p_partkey % 3 = 0 THEN 'info' ELSE concat('jane', CAST(p_partkey AS STRING)) END, '@acme', CAST(p_partkey % 7 AS STRING), '.fi') END AS email,
          CASE WHEN p_partkey % 5 < 3 THEN NULL ELSE concat('+3584', CAST(1000000 + p_partkey * 7919 % 8999999 AS STRING), '5') END AS phone
        FROM {part}""",
    "results": f"""
        SELECT l_orderkey AS job_id, l_suppkey AS company_id, l_partkey AS part_id, l_linenumber AS line, {_pick("l_partkey % 10", STAGES)} AS stage,
          CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_linenumber END AS rank, CASE WHEN l_partkey % 17 = 0 THEN 'timeout' WHEN l_partkey % 17 = 1 THEN '' ELSE NULL END AS stage_error,
          CAST(l_shipdate AS DATE) AS discovered_on FROM {{lineitem}}""",
    "jobs": """
        SELECT o_orderkey AS job_id, o_custkey AS user_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'PENDING' WHEN '2-HIGH' THEN 'CRAWLING' WHEN '3-MEDIUM' THEN 'ENRICHING' WHEN '4-NOT SPECIFIED' THEN 'COMPLETED' ELSE 'FAILED' END AS status,
          CAST(o_orderdate AS DATE) AS created_on, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 20 AS INT) END AS company_limit FROM {orders}""",
    "signals": """
        SELECT event_id AS signal_id, user_id AS company_id, CASE event_type WHEN 'click' THEN 'HIRING' WHEN 'signup' THEN 'EXPANSION' WHEN 'purchase' THEN 'FUNDING' WHEN 'error' THEN 'PRODUCT_LAUNCH' ELSE 'OTHER' END AS type,
          least(1.0E0, value / 500.0E0) AS confidence, ts AS detected_at FROM {events}""",
    "delivery": """
        SELECT event_id, user_id AS recipient_id, CASE event_type WHEN 'view' THEN 'OPENED' WHEN 'click' THEN 'CLICKED' WHEN 'signup' THEN 'DELIVERED' WHEN 'purchase' THEN 'REPLIED' ELSE 'BOUNCED' END AS status,
          ts AS occurred_at FROM {events}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{x: view(spark, sf_dir, x) for x in used})


def oracle(sql: str) -> str:
    """SQL for DuckDB: every view that the text names in braces becomes a CTE."""
    used = list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))
    plain = lambda x: re.sub(r"\{(\w+)\}", r"\1", x)
    parts = [f"{x} AS ({plain(VIEWS[x])})" for x in used if x in VIEWS]
    body = plain(sql).strip()
    if not parts:
        return body
    if body[:4].upper() == "WITH":
        return f"WITH {', '.join(parts)}, {body[4:].lstrip()}"
    return f"WITH {', '.join(parts)} {body}"
