"""The domain's tables, derived from the supplied star schema by integer arithmetic.

One SQL text serves both engines, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from batonflow.staging import grown

# Statements: an event says something about a capability (props.k) of a user's account.
OBJ = """
SELECT event_id AS id, user_id % 5 AS tenant_id, user_id AS entity_id,
  concat('e', user_id, ':', CASE WHEN k % 12 = 0 THEN 'sso' ELSE concat('c', k % 12) END) AS subject_key,
  CASE event_id % 5 WHEN 0 THEN 'sales' WHEN 1 THEN 'product' WHEN 2 THEN 'engineering' WHEN 3 THEN 'customer_success' ELSE 'leadership' END AS stage,
  CASE event_type WHEN 'view' THEN 'requirement' WHEN 'error' THEN 'problem' WHEN 'signup' THEN 'commitment' WHEN 'click' THEN 'constraint' ELSE 'decision' END AS type,
  CAST((event_id * 7) % 5 AS INT) AS authority,
  CASE CAST((event_id + k) % 6 AS INT) WHEN 0 THEN 'required' WHEN 1 THEN 'deferred' WHEN 2 THEN 'in_progress' WHEN 3 THEN 'done' WHEN 4 THEN 'dropped' ELSE 'rejected' END AS stance,
  CASE WHEN event_id % 7 = 0 THEN 'conflicting' WHEN event_id % 11 = 0 THEN 'superseded' WHEN event_id % 13 = 0 THEN 'candidate' ELSE 'active' END AS status,
  CASE event_id % 8 WHEN 0 THEN 'customer' WHEN 1 THEN 'product' WHEN 2 THEN 'leadership' WHEN 3 THEN 'sales' WHEN 4 THEN 'engineering' ELSE 'other' END AS role,
  CAST((event_id * 13) % 101 AS INT) AS conf100, CAST(event_id % 997 AS BIGINT) AS source_id, CAST(event_id % 40 AS INT) AS person_id,
  CAST(event_id % 3 + 1 AS INT) AS version, k, ts AS valid_from
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e"""

# Sources: what the statements were read from.
SRC = """
SELECT CAST(s AS BIGINT) AS source_id, CASE CAST(s % 4 AS INT) WHEN 0 THEN 'slack' WHEN 1 THEN 'email' WHEN 2 THEN 'drive' ELSE 'call' END AS kind,
  CASE CAST(s % 3 AS INT) WHEN 0 THEN '*' WHEN 1 THEN 'team:sales-private' ELSE 'team:engineering' END AS reader FROM (SELECT DISTINCT event_id % 997 AS s FROM events) x"""

# Values of the statements' slots.
VALUES = {
    "protocol": "CASE id % 6 WHEN 0 THEN 'SAML' WHEN 1 THEN 'OIDC' WHEN 2 THEN ' saml 2.0' WHEN 3 THEN 'sso' WHEN 4 THEN '' END",
    "idp": "CASE k % 3 WHEN 0 THEN 'Okta' WHEN 1 THEN 'Entra' END",
    "region": "CASE id % 7 WHEN 0 THEN 'us-east-1' WHEN 1 THEN 'us-west-2' WHEN 2 THEN 'US' WHEN 3 THEN 'eu-west-1' WHEN 4 THEN 'EU' WHEN 5 THEN 'ap-1' END",
    "due_date": "CASE WHEN k % 4 <> 0 THEN concat('2024-0', CAST(id % 9 + 1 AS VARCHAR(2)), '-15') END",
    "due_date_precision": "CASE id % 4 WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'quarter' END",
    "priority": "CASE WHEN id % 3 <> 0 THEN concat('P', CAST(k % 3 AS VARCHAR(2))) END",
    "quantity": "CAST((k % 5) * 50 AS VARCHAR(8))",
    "plan": "CASE WHEN id % 2 = 0 THEN concat('plan ', CAST(k % 2 AS VARCHAR(2))) END",
    "rationale": "CASE WHEN id % 5 <> 1 THEN concat('because ', CAST(k % 4 AS VARCHAR(2))) END",
    "root_cause": "CASE WHEN id % 3 = 0 THEN concat('cause ', CAST(k % 6 AS VARCHAR(2))) END",
    "integrations": """CASE id % 5 WHEN 0 THEN '["Okta","Jira"]' WHEN 1 THEN '["jira", " okta "]' WHEN 2 THEN '["Okta"]' WHEN 3 THEN '[]' END""",
    "impact": """CASE id % 4 WHEN 0 THEN '{"data_loss":"none","customers":"12"}' WHEN 1 THEN '{"customers":"40","data_loss":"None"}' WHEN 2 THEN '{"data_loss":"partial"}' ELSE '{}' END""",
    "time_window": """CASE id % 3 WHEN 0 THEN '{"start":"09:00","end":"10:00"}' WHEN 1 THEN '{"end":"11:00","start":"09:00"}' WHEN 2 THEN 'all day' END""",
    "acceptance_criteria": """CASE WHEN id % 2 = 1 THEN '["done"]' ELSE '[]' END""",
}

# Slots of the statements, one row each; the first names the columns.
_PARTS = [f"SELECT id, '{slot}'{' AS slot' if not i else ''}, {value}{' AS value' if not i else ''} FROM obj" for i, (slot, value) in enumerate(VALUES.items())]
SLOTS = "\nSELECT id, slot, value FROM (\n  " + "\n  UNION ALL ".join(_PARTS) + "\n) x WHERE value IS NOT NULL"

# Upstream and downstream statements on one subject, by stage and strictly by time.
PAIRS = "SELECT * FROM (VALUES ('sales','product'),('product','engineering'),('sales','customer_success'),('engineering','sales'),('engineering','customer_success')) AS p(up, down)"
REL = """
SELECT d.id AS from_id, u.id AS to_id FROM obj d JOIN obj u ON u.tenant_id = d.tenant_id AND u.entity_id = d.entity_id AND u.subject_key = d.subject_key
JOIN pairs p ON p.up = u.stage AND p.down = d.stage WHERE u.valid_from < d.valid_from"""

#: WITH list for the oracle: each name after those that it reads.
WITH = {"obj": OBJ, "src": SRC, "slots": SLOTS, "pairs": PAIRS, "rel": REL}


def with_clause(*names: str) -> str:
    return ", ".join(f"{n} AS ({WITH[n]})" for n in names)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OBJ.replace("FROM events)", "FROM {events})"), events=read(spark, sf_dir, "events"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SRC.replace("FROM events)", "FROM {events})"), events=read(spark, sf_dir, "events"))


def with_values(objects: DataFrame) -> DataFrame:
    """`objects` with `values`, a struct of its slots, null where one isn't given: a statement's slots are of its own row, so none is shuffled."""
    return objects.withColumn("values", F.struct(*[F.expr(value).alias(slot) for slot, value in VALUES.items()]))


def slots_long(objects: DataFrame, *names: str) -> DataFrame:
    """SLOTS in one scan of `objects`: all, or those of `names`."""
    rows = objects.select("id", F.inline(F.array(*[F.struct(F.lit(slot).alias("slot"), F.expr(VALUES[slot]).alias("value")) for slot in names or VALUES])))
    return grown(rows.where("value IS NOT NULL"))


def join_values(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """`rows` with `values` of with_values(), by id: what SLOTS give them by id, shuffled as a row a statement. See each_value()."""
    return rows.join(grown(with_values(objects).select("id", "values")), "id")


def each_value() -> Column:
    """A generator of (slot, value) of join_values(), null values among them."""
    return F.inline(F.array(*[F.struct(F.lit(slot).alias("slot"), F.col("values")[slot].alias("value")) for slot in VALUES]))
