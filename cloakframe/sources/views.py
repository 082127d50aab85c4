"""Input tables and the derived views every plan reads.

One SQL text per view; ``@name`` stands for a base table or another view, so the same
text serves Spark (parquet scans) and the reference engine used in the checks.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("documents", "pages", "conversations", "events", "customer", "orders")

VIEWS: dict[str, str] = {
    "prompts": """
SELECT c_custkey AS prompt_id,
       CASE WHEN c_custkey % 2 = 0 THEN 'sovereign-local' ELSE 'external-cloud' END AS destination,
       CASE CAST(c_custkey % 12 AS INT)
         WHEN 0 THEN concat('Customer Omar Khan holds QID ', CAST(28400000000 + c_custkey AS STRING), ' and card 4111 1111 1111 1111.')
         WHEN 1 THEN concat('Pay to IBAN QA58DOHB', CAST(100000000000 + c_custkey AS STRING), ' for client Sara Costa.')
         WHEN 2 THEN concat('Passport K', CAST(10000000 + c_custkey AS STRING), ' belongs to Dr. Reem Nair.')
         WHEN 3 THEN concat('Token AKIAABCDEFGH', CAST(10000000 + c_custkey AS STRING), ' leaked, mail ops', CAST(c_custkey AS STRING), '@example.qa')
         WHEN 4 THEN concat('Summarise MRN: ', CAST(500000 + c_custkey AS STRING), ' diagnosed with asthma, DOB 1990-01-02.')
         WHEN 5 THEN concat('Call +974 5512 ', CAST(1000 + c_custkey % 9000 AS STRING), ' about Villa 12 West Bay.')
         WHEN 6 THEN concat('Card 4111111111111112 fails, order ', CAST(c_custkey AS STRING))
         WHEN 7 THEN concat('Email a', CAST(c_custkey % 5 AS STRING), '@x.qa then a', CAST(c_custkey % 5 AS STRING), '@x.qa again')
         WHEN 8 THEN concat('Dispute on card 4111-1111-1111-1111 by member Maha Santos, ref ', CAST(c_custkey AS STRING))
         WHEN 9 THEN concat('IBAN US58DOHB', CAST(100000000000 + c_custkey AS STRING), ' is out of the country list')
         WHEN 10 THEN concat('SSN 123-45-', CAST(1000 + c_custkey % 9000 AS STRING), ' from 10.0.0.', CAST(c_custkey % 300 AS STRING))
         ELSE concat('No sensitive data in ticket ', CAST(c_custkey % 100 AS STRING)) END AS text
FROM @customer""",
    "corpus": """
SELECT 'document' AS kind, doc_id AS id, text FROM @documents
UNION ALL SELECT 'page' AS kind, page_id AS id, html AS text FROM @pages
UNION ALL SELECT 'prompt' AS kind, prompt_id AS id, text FROM @prompts""",
    "portfolio": """
SELECT c.c_custkey AS row_ord,
       concat('Customer ', CAST(c.c_custkey % 700 AS STRING)) AS customer_name,
       CAST(28400000000 + c.c_custkey AS STRING) AS qid,
       concat('QA58DOHB', CAST(100000000000 + c.c_custkey AS STRING)) AS iban,
       c.c_mktsegment AS segment,
       CAST(7000 + (c.c_custkey * 37) % 20000 AS DOUBLE) AS monthly_salary,
       CAST(coalesce(o.debt, 0) AS DOUBLE) / 60 AS outstanding_loan,
       CAST(CASE WHEN c.c_custkey % 3 = 0 THEN (c.c_custkey * 5) % 195 ELSE 0 END AS INT) AS days_past_due
FROM @customer c LEFT JOIN (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS debt FROM @orders GROUP BY o_custkey) o
  ON o.o_custkey = c.c_custkey""",
    "audit_log": """
SELECT event_id AS id, concat('user', CAST(user_id AS STRING)) AS actor, event_type AS action,
       CAST(NULL AS STRING) AS target, props AS meta, ts AS created_at FROM @events""",
    "auth_attempts": """
SELECT event_id AS id, user_id AS ip, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS success, ts AS at FROM @events""",
    "sessions": """
SELECT concat('tok', lpad(CAST(user_id AS STRING), 5, '0')) AS token, user_id,
       CASE user_id % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'operator' WHEN 2 THEN 'auditor' WHEN 3 THEN 'viewer' ELSE 'bogus' END AS role,
       min(ts) AS created_at, max(ts) AS last_seen_at,
       CASE WHEN user_id % 3 = 0 THEN min(ts) + INTERVAL 8 HOURS END AS expires_at,
       CASE WHEN user_id % 7 = 0 THEN min(ts) + INTERVAL 20 DAYS END AS revoked_at
FROM @events GROUP BY user_id""",
    "messages": """
SELECT conv_id, turn, role,
       CASE WHEN role = 'user' THEN concat(text, ' Customer Omar Khan, mail u', CAST(conv_id % 9 AS STRING), '@x.qa',
            CASE WHEN turn > 0 THEN ', and Omar Khan again.' ELSE '.' END) ELSE text END AS text
FROM @conversations""",
    "known_values": """
SELECT conv_id, '[NAME_1]' AS placeholder, 'Omar Khan' AS value, 1 AS ord FROM @messages WHERE role = 'user' GROUP BY conv_id
UNION ALL SELECT conv_id, '[EMAIL_1]' AS placeholder, concat('u', CAST(conv_id % 9 AS STRING), '@x.qa') AS value, 2 AS ord
FROM @messages WHERE role = 'user' GROUP BY conv_id
UNION ALL SELECT conv_id, '[NAME_2]' AS placeholder, 'Omar' AS value, 3 AS ord FROM @messages WHERE role = 'user' GROUP BY conv_id""",
    "replies": """
SELECT c_custkey AS reply_id,
       CASE CAST(c_custkey % 4 AS INT)
         WHEN 0 THEN concat('```json {"headline":"h","groups":[{"tier":"High risk","rule":"r","members":["[NAME_', CAST(c_custkey + 1 AS STRING), ']"],"summary":"s"}]} ```')
         WHEN 1 THEN concat('Here it is: {"headline":"h","groups":[{"tier":"Low risk","rule":"r","members":["[NAME_', CAST(c_custkey + 1 AS STRING), ']"],"summary":"s"}]} Done.')
         WHEN 2 THEN 'no json here'
         ELSE '{"groups": [broken}' END AS text
FROM @customer""",
    "model_replies": """
SELECT c_custkey AS reply_id, c_custkey % 100 + 1 AS k,
       replace(CASE CAST(c_custkey % 7 AS INT)
         WHEN 0 THEN '```json {"headline":"About [NAME_k] today","groups":[{"tier":"High risk","rule":"late","members":["[NAME_k]","[QID_k]"],"summary":"[NAME_k] owes"},{"tier":"Low risk","members":"none"}]} ```'
         WHEN 1 THEN 'Here: {"headline":7,"groups":["broken",{"tier":"Low risk","rule":["r"],"members":[" [NAME_k] ",5,{"a":1},null],"summary":"[QID_k]"},{"rule":"no tier"}]} Done.'
         WHEN 2 THEN 'no json here'
         WHEN 3 THEN '{"groups": [broken}'
         WHEN 4 THEN '{"drafts":[{"id":"[NAME_k]","en":"Dear [NAME_k], [QID_k]","ar":"[NAME_k]"},{"name":"[QID_k]","en":null},"broken",{"id":"","name":"","ar":"x"}]}'
         WHEN 5 THEN '{"drafts":{"id":"a"},"groups":[]}'
         ELSE '{"headline":"","groups":[{"tier":"Medium risk","members":[],"summary":"[IBAN_k] stays"}],"drafts":[{"id":9,"en":["x"],"ar":"[NAME_k][NAME_k]"}]}' END,
         '_k]', concat('_', CAST(c_custkey % 100 + 1 AS STRING), ']')) AS text
FROM @customer""",
    "headers": """
SELECT CAST(floor(c_custkey / 13) AS BIGINT) AS file_id, c_custkey % 13 AS ord,
       concat(CASE CAST(c_custkey % 13 AS INT) WHEN 0 THEN 'Customer Name' WHEN 1 THEN 'QID' WHEN 2 THEN 'IBAN' WHEN 3 THEN 'Mobile' WHEN 4 THEN 'Product'
              WHEN 5 THEN 'Company' WHEN 6 THEN 'Account Name' WHEN 7 THEN 'c_acctbal' WHEN 8 THEN 'Days Past Due' WHEN 9 THEN 'Outstanding Loan (QAR)'
              WHEN 10 THEN 'Monthly Salary (QAR)' WHEN 11 THEN ' E-Mail ' ELSE 'Birth date' END,
              CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat(' ', lower(c_mktsegment)) END) AS header
FROM @customer""",
    "settings": """
SELECT concat('k', CAST(user_id % 10 AS STRING)) AS key, event_type AS value, event_id AS seq FROM @events""",
}

_NAME = re.compile(r"@(\w+)")


def spark_sql_of(view: str, sf_dir: str) -> str:
    def resolve(match: re.Match) -> str:
        name = match.group(1)
        if name in VIEWS:
            return f"({spark_sql_of(name, sf_dir)})"
        if name in BASE_TABLES:
            return f"parquet.`{sf_dir.rstrip('/')}/{name}.parquet`"
        return match.group(0)

    return _NAME.sub(resolve, VIEWS[view])


# Views whose texts are searched: the work per byte is high, so idle cores are worth a shuffle.
TEXT_VIEWS = ("corpus", "prompts", "messages")
# Views that make a text of every customer, and what they read of one.
CUSTOMER_TEXTS = {"corpus": ["c_custkey"], "prompts": ["c_custkey"], "replies": ["c_custkey"], "model_replies": ["c_custkey"]}
CORPUS_TABLES = {"documents": ["doc_id", "text"], "pages": ["page_id", "html"]}
TASKS_PER_CORE = 2


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if name in VIEWS:
        if name not in CUSTOMER_TEXTS:
            rows = spark.sql(spark_sql_of(name, sf_dir))
            return spread(rows) if name in TEXT_VIEWS else rows
        # A file of customers is one split of many short rows, and each becomes a text: they are dealt out by number, not by bytes.
        customers = dealt(spark.read.parquet(f"{sf_dir.rstrip('/')}/customer.parquet").select(*CUSTOMER_TEXTS[name]))
        parts = {"customer": customers}
        if name == "corpus":
            prompts = named(spark, "prompts", parts)
            parts = {t: spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet").select(*columns)) for t, columns in CORPUS_TABLES.items()}
            parts["prompts"] = prompts
        return named(spark, name, parts)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def named(spark: SparkSession, view: str, parts: dict[str, DataFrame]) -> DataFrame:
    """A view over the given tables."""
    for part, df in parts.items():
        df.createOrReplaceTempView(f"part_{part}")
    return spark.sql(_NAME.sub(lambda m: f"part_{m.group(1)}" if m.group(1) in parts else m.group(0), VIEWS[view]))


def dealt(df: DataFrame) -> DataFrame:
    """Deal out short rows evenly over several tasks per core, whatever their files are."""
    return df.repartition(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """Use every core when the files give fewer splits than there are cores.

    Large inputs give more splits than cores and stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def check_sql(*views: str) -> str:
    """The views as common table expressions, in dependency order, for the check engine."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in _NAME.findall(VIEWS[name]):
            if dep in VIEWS:
                visit(dep)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        visit(view)

    def plain(match: re.Match) -> str:
        name = match.group(1)
        return name if name in VIEWS or name in BASE_TABLES else match.group(0)

    return ",\n".join(f"{name} AS ({_NAME.sub(plain, VIEWS[name])})" for name in ordered)
