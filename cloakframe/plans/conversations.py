"""Conversation logs, their vaults, the screening profile and erasure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe import catalogue as c
from cloakframe.functions.masking import mask_value
from cloakframe.functions.redaction import with_redaction, with_spans
from cloakframe.operators import conversation as C
from cloakframe.operators import screening as S
from cloakframe.operators import snapshots as N
from cloakframe.operators import vault as V
from cloakframe.operators.restore import restore_text
from cloakframe.operators.substring_join import occurrences
from cloakframe.plans.checksql import chat_round_ctes, lit, mask_sql, re2, redacted_ctes, reply_sql, spaced, spans_ctes, trim_sql
from cloakframe.plans.registry import plan
from cloakframe.session import materialise, scratch_path
from cloakframe.sources.views import load

MESSAGES = ["messages"]
KNOWN = ["messages", "known_values"]
USERS = f"users AS MATERIALIZED (SELECT conv_id, turn, {trim_sql('text')} AS text FROM messages WHERE role = 'user' AND {trim_sql('text')} <> '')"
USER_KEPT = spans_ctes("users", "conv_id, turn")
SCREEN_KEPT = spans_ctes("corpus", "kind, id", c.SCREENING, ranked=False)
DEMO_KEY = "00112233445566778899aabbccddeeff00112233445566778899aabbccddeeff"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "messages")


def _redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.redact_conversations(messages(spark, sf_dir))


CHAT = [USERS, *chat_round_ctes()]
CHAT_ROWS = spaced(MESSAGES, CHAT, "SELECT conv_id, turn, redacted, protected_count, n_new FROM chat")
CLASS_OF = ", ".join(f"({i}, {lit(d.sensitivity)}, {lit(d.label)}, {c.TIER_RANK[d.sensitivity]})" for i, d in enumerate(c.DETECTORS))


@plan("chat_redact_fold", CHAT_ROWS)
def chat_redact_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _redacted(spark, sf_dir)
    return done.select("conv_id", "turn", "redacted", "protected_count", F.size("entries").cast("long").alias("n_new"))


@plan("chat_redact_long", CHAT_ROWS)
def chat_redact_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = C.redact_conversations(messages(spark, sf_dir))
    return done.select("conv_id", "turn", "redacted", "protected_count", F.size("entries").cast("long").alias("n_new"))


@plan(
    "chat_messages_redacted",
    spaced(MESSAGES, CHAT, f"""SELECT conv_id, turn, 'user' AS role, redacted AS content, protected_count FROM chat UNION ALL
SELECT conv_id, turn, role, text, len(list_distinct(regexp_extract_all(text, {re2(chr(92) + '[[A-Z]+_[0-9]+' + chr(92) + ']')}))) FROM messages WHERE role <> 'user'"""),
)
def chat_messages_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stored_messages(messages(spark, sf_dir), _redacted(spark, sf_dir))


@plan(
    "chat_audit_metrics",
    spaced(MESSAGES, CHAT, f"""SELECT conv_id, turn, protected_new, CAST(protected_total AS BIGINT) AS protected_total,
CASE top WHEN 3 THEN 'restricted' WHEN 2 THEN 'confidential' WHEN 1 THEN 'internal' END AS sensitivity FROM (
SELECT c.conv_id, c.turn, c.n_new AS protected_new, sum(c.n_new) OVER w AS protected_total, max(r.rank) OVER w AS top
FROM chat c LEFT JOIN (SELECT conv_id, first.t AS turn, max(k.rank) AS rank FROM chat_vault v JOIN (VALUES {CLASS_OF}) AS k(det, sensitivity, label, rank) ON k.det = v.det GROUP BY ALL) r
ON r.conv_id = c.conv_id AND r.turn = c.turn WINDOW w AS (PARTITION BY c.conv_id ORDER BY c.turn))"""),
)
def chat_audit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.audit_metrics(_redacted(spark, sf_dir))


@plan(
    "protected_fields",
    spaced(MESSAGES, CHAT, f"""SELECT conv_id, mark AS placeholder, label, sensitivity, {mask_sql()} AS masked
FROM chat_vault v JOIN (VALUES {CLASS_OF}) AS k(det, sensitivity, label, rank) ON k.det = v.det"""),
)
def protected_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.conversation_vault(_redacted(spark, sf_dir)).select("conv_id", "placeholder", "label", "sensitivity", "masked")


@plan("reidentify", spaced(MESSAGES, [USERS], "SELECT conv_id, turn, text AS restored FROM users"))
def reidentify(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = materialise(_redacted(spark, sf_dir))
    vault = C.conversation_vault(done).select("conv_id", "ord", "placeholder", "value")
    texts = done.select("conv_id", "turn", "redacted")
    return restore_text(texts, ["conv_id", "turn"], ["conv_id"], "redacted", vault, "restored").drop("redacted")


@plan(
    "conversation_view",
    spaced(MESSAGES, [USERS], "SELECT conv_id, turn, 'user' AS role, text AS real FROM users UNION ALL SELECT conv_id, turn, role, text FROM messages WHERE role <> 'user'"),
)
def conversation_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = materialise(_redacted(spark, sf_dir))
    vault = C.conversation_vault(done).select("conv_id", "ord", "placeholder", "value")
    stored = C.stored_messages(messages(spark, sf_dir), done).drop("protected_count")
    view = restore_text(stored, ["conv_id", "turn"], ["conv_id"], "content", vault, "real")
    return view.select("conv_id", "turn", "role", "real")


@plan(
    "known_value_hits",
    spaced(KNOWN, [], "SELECT m.conv_id, m.turn, k.placeholder FROM messages m JOIN known_values k ON k.conv_id = m.conv_id AND contains(m.text, k.value)"),
)
def known_value_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = occurrences(messages(spark, sf_dir), "turn", "text", ["conv_id"], load(spark, sf_dir, "known_values"), "value")
    return hits.select("conv_id", "turn", F.explode("found.placeholder").alias("placeholder"))


REPLACED = """replaced AS MATERIALIZED (SELECT m.conv_id, m.turn, m.role, CASE WHEN k.conv_id IS NULL THEN m.text ELSE
replace(replace(replace(m.text, 'Omar Khan', '[NAME_1]'), concat('u', m.conv_id % 9, '@x.qa'), '[EMAIL_1]'), 'Omar', '[NAME_2]') END AS content
FROM messages m LEFT JOIN (SELECT DISTINCT conv_id FROM known_values) k ON k.conv_id = m.conv_id)"""


def _known_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir)
    known = load(spark, sf_dir, "known_values")
    hits = occurrences(rows, "turn", "text", ["conv_id"], known, "value")
    ordered = F.array_sort(
        F.transform("found", lambda k: F.struct((-F.length(k["value"])).alias("by_len"), k["ord"], k["value"], k["placeholder"].alias("mark")))
    )
    joined = rows.join(hits.select("conv_id", "turn", ordered.alias("known")), ["conv_id", "turn"], "left")
    done = C.apply_known(F.col("text"), F.col("known"))
    return joined.select("conv_id", "turn", "role", done["work"].alias("content"))


@plan("apply_known_values", spaced(KNOWN, [REPLACED], "SELECT conv_id, turn, content FROM replaced"))
def apply_known_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known_applied(spark, sf_dir).select("conv_id", "turn", "content")


NUMBERED = """firsts AS MATERIALIZED (SELECT conv_id, det, type, value, first.t AS first_turn, first.s AS first_pos FROM (
  SELECT conv_id, det, type, value, min({'t': turn, 's': start}) AS first FROM kept GROUP BY conv_id, det, type, value)),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id, type ORDER BY first_turn, first_pos) AS idx FROM firsts)"""


def _numbered(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    rows = messages(spark, sf_dir) if rows is None else rows
    turns = C.in_order(C.user_turns(rows).select("conv_id", "turn", "text"))
    numbered = C.number_rows(C.first_seen(with_spans(turns)), ["conv_id", "type"], ["first_at", "first_pos"], "idx")
    return numbered.withColumn("first_turn", C.turn_of("first_at"))


@plan(
    "conv_first_seen_numbering",
    spaced(MESSAGES, [USERS, USER_KEPT, NUMBERED], f"SELECT conv_id, type, idx, first_turn, CAST(first_pos AS BIGINT) AS first_pos, {mask_sql()} AS masked FROM numbered"),
)
def conv_first_seen_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).select(
        "conv_id", "type", "idx", "first_turn", F.col("first_pos").cast("long").alias("first_pos"),
        mask_value(F.col("type"), F.col("value")).alias("masked"),
    )


@plan(
    "next_placeholder_index",
    spaced(MESSAGES, [USERS, USER_KEPT, NUMBERED], "SELECT conv_id, type, max(idx) + 1 AS next_index FROM numbered GROUP BY conv_id, type"),
)
def next_placeholder_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = _numbered(spark, sf_dir).select("conv_id", C.placeholder(F.col("type"), F.col("idx")).alias("placeholder"))
    return C.next_index(marks)


@plan(
    "vault_insert_new",
    spaced(MESSAGES, [USERS, USER_KEPT, NUMBERED], f"""SELECT conv_id, concat('[', type, '_', idx, ']') AS placeholder, {mask_sql()} AS masked
FROM numbered WHERE NOT (type = 'NAME' AND idx = 1 AND conv_id % 2 = 0)"""),
)
def vault_insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbered(spark, sf_dir).select(
        "conv_id", C.placeholder(F.col("type"), F.col("idx")).alias("placeholder"),
        mask_value(F.col("type"), F.col("value")).alias("masked"), F.lit(1).alias("ord"),
    )
    rows = materialise(rows)
    held = rows.where("placeholder = '[NAME_1]' AND conv_id % 2 = 0")
    again = rows.withColumn("masked", F.lit("late")).withColumn("ord", F.lit(2))
    return V.insert_new(held, rows.unionByName(again)).select("conv_id", "placeholder", "masked")


@plan(
    "vault_encrypt_roundtrip",
    spaced(["corpus"], [spans_ctes("corpus"), redacted_ctes("corpus")], "SELECT kind, id, placeholder, masked, TRUE AS same, '' AS altered FROM entity"),
)
def vault_encrypt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = with_redaction(load(spark, sf_dir, "corpus"))
    rows = done.select("kind", "id", F.inline_outer("entities")).where("type IS NOT NULL")
    key = V.key_from_hex(DEMO_KEY)
    # Kept in a table, as a vault is: the random IV must not be drawn again by a later read.
    stored = materialise(rows.select("kind", "id", "placeholder", "masked", "value", V.encrypt(F.col("value"), key).alias("cell")))
    broken = F.concat(F.unhex(F.lit("00")), F.col("cell"))
    return stored.select(
        "kind", "id", "placeholder", "masked",
        (V.decrypt(F.col("cell"), key) == F.col("value")).alias("same"),
        V.decrypt(broken, key).alias("altered"),
    )


@plan(
    "erase_conversations",
    spaced(MESSAGES, [USERS, USER_KEPT, NUMBERED], """SELECT 'message' AS kept_in, conv_id, count(*) AS n FROM messages WHERE conv_id % 10 <> 3 GROUP BY conv_id
UNION ALL SELECT 'vault', conv_id, count(*) FROM numbered WHERE conv_id % 10 <> 3 GROUP BY conv_id"""),
)
def erase_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir)
    listed = rows.where("conv_id % 10 = 3").select("conv_id").distinct()
    parts = {"message": rows, "vault": _numbered(spark, sf_dir)}
    left = [
        V.erase(table, listed, "conv_id").groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("kept_in", F.lit(name))
        for name, table in parts.items()
    ]
    return left[0].unionByName(left[1])


@plan(
    "list_conversations",
    spaced(MESSAGES, [USERS, USER_KEPT, NUMBERED], """SELECT c.conv_id, c.updated_at, coalesce(m.n, 0) AS message_count, coalesce(v.n, 0) AS protected_count
FROM (SELECT conv_id, TIMESTAMP '2024-01-01' + to_minutes(conv_id * 37 % 1000) AS updated_at FROM messages GROUP BY conv_id) c
LEFT JOIN (SELECT conv_id, count(*) AS n FROM messages GROUP BY conv_id) m ON m.conv_id = c.conv_id
LEFT JOIN (SELECT conv_id, count(*) AS n FROM numbered GROUP BY conv_id) v ON v.conv_id = c.conv_id
ORDER BY c.updated_at DESC, c.conv_id DESC LIMIT 100"""),
)
def list_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir)
    conversations = rows.select("conv_id").distinct().withColumn(
        "updated_at", F.expr("timestampadd(MINUTE, conv_id * 37 % 1000, TIMESTAMP_NTZ '2024-01-01 00:00:00')")
    )
    # The page is chosen first, so only its own messages are searched.
    page = C.newest(conversations)
    shown = rows.join(page.select("conv_id"), "conv_id", "left_semi")
    return C.list_conversations(page, shown, _numbered(spark, sf_dir, shown))


@plan(
    "conversation_secure",
    spaced(MESSAGES, [USERS, USER_KEPT], "SELECT u.conv_id, bool_or(k.conv_id IS NOT NULL) AS secure FROM users u LEFT JOIN (SELECT DISTINCT conv_id FROM kept) k ON k.conv_id = u.conv_id GROUP BY u.conv_id"),
)
def conversation_secure(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = with_spans(C.user_turns(messages(spark, sf_dir)))
    return spans.groupBy("conv_id").agg(F.bool_or(F.size("spans") > 0).alias("secure"))


FIRST_TURN = "firstly AS (SELECT * FROM users u WHERE turn = (SELECT min(turn) FROM users x WHERE x.conv_id = u.conv_id))"


@plan(
    "conversation_titles",
    spaced(MESSAGES, [USERS, FIRST_TURN, spans_ctes("firstly", "conv_id, turn"), redacted_ctes("firstly", "conv_id, turn")],
           f"SELECT conv_id, left({trim_sql('regexp_replace(redacted, ' + lit(c.SPACE + '+') + ', chr(32), chr(103))')}, 60) AS title FROM redacted"),
)
def conversation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = C.user_turns(messages(spark, sf_dir))
    first = turns.groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("f")).select("conv_id", "f.*")
    return C.titles(with_redaction(first))


@plan("latest_user_turn", spaced(MESSAGES, [], "SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS last_text FROM messages GROUP BY conv_id"))
def latest_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.latest_user_turn(messages(spark, sf_dir))


@plan(
    "conversation_state",
    spaced(MESSAGES, [], f"""SELECT conv_id, left(coalesce(arg_max(text, turn) FILTER (role = 'user'), 'New chat'), 120) AS title, bool_or(contains(text, '@')) AS secure, max(turn) AS updated_at
FROM messages GROUP BY conv_id"""),
)
def conversation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = messages(spark, sf_dir).select(
        "conv_id", F.col("turn").alias("at"), F.when(F.col("role") == "user", F.col("text")).alias("title"),
        F.contains("text", F.lit("@")).alias("secure"),
    )
    return C.conversation_state(updates)


@plan("conversation_messages", spaced(MESSAGES, [], "SELECT turn, role, text FROM messages WHERE conv_id = 5 ORDER BY turn"))
def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).where("conv_id = 5").orderBy("turn").select("turn", "role", "text")


CHAT_FACTS = f"""tokens AS (SELECT conv_id, turn, unnest(range(1, len(m) + 1)) AS pos, unnest(m) AS token FROM (
  SELECT conv_id, turn, regexp_extract_all(content, {re2(chr(92) + '[[A-Z]+_[0-9]+' + chr(92) + ']')}) AS m FROM replaced)),
seen AS (SELECT conv_id, token, min({{'t': turn, 'p': pos}}) AS f FROM tokens GROUP BY conv_id, token),
lasts AS (SELECT conv_id, coalesce(arg_max(content, turn) FILTER (role = 'user'), '') AS last_text FROM replaced GROUP BY conv_id),
chats AS (SELECT l.conv_id, l.last_text, coalesce(s.ph, []) AS ph FROM lasts l LEFT JOIN (SELECT conv_id, list(token ORDER BY f) AS ph FROM seen GROUP BY conv_id) s ON s.conv_id = l.conv_id)"""
CHAT_NAME = "list_filter(ph, lambda p: starts_with(p, '[NAME'))[1]"
CHAT_REPLY = reply_sql(
    "lower(last_text)",
    c.CHAT_INTENTS,
    c.CHAT_REPLIES,
    {
        "who": f"coalesce({CHAT_NAME}, {lit(c.CHAT_NOBODY)})",
        "card": "coalesce(' on card ' || list_filter(ph, lambda p: starts_with(p, '[PAN'))[1], '')",
        "others": f"CASE WHEN len(ph) > 1 THEN concat({lit(c.CHAT_OTHERS[0])}, len(ph) - 1, {lit(c.CHAT_OTHERS[1])}) ELSE '' END",
        "regarding": f"coalesce(', regarding ' || {CHAT_NAME}, '')",
        "fields": f"CASE WHEN len(ph) > 0 THEN concat({lit(c.CHAT_FIELDS[0])}, len(ph), {lit(c.CHAT_FIELDS[1])}, array_to_string(ph, ', '), {lit(c.CHAT_FIELDS[2])}) ELSE '' END",
    },
)


@plan("respond_chat", spaced(KNOWN, [REPLACED, CHAT_FACTS], f"SELECT conv_id, {CHAT_REPLY} AS reply FROM chats"))
def respond_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chat_replies(materialise(_known_applied(spark, sf_dir)))


FINDINGS = """findings AS MATERIALIZED (SELECT kind, id, type, start, value, row_number() OVER (PARTITION BY kind, id ORDER BY start) AS nth,
  concat('[', type, '_', row_number() OVER (PARTITION BY kind, id, type ORDER BY start), ']') AS placeholder FROM kept)"""


@plan("screen_findings", spaced(["corpus"], [SCREEN_KEPT, FINDINGS], f"SELECT kind, id, type, placeholder, start AS start_pos, {mask_sql()} AS masked FROM findings"))
def screen_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.with_findings(load(spark, sf_dir, "corpus")).select("kind", "id", F.inline_outer("findings")).where("type IS NOT NULL")
    return rows.select(
        "kind", "id", "type", "placeholder", F.col("start").cast("long").alias("start_pos"),
        mask_value(F.col("type"), F.col("value")).alias("masked"),
    )


@plan(
    "screen_redact",
    spaced(["corpus"], [SCREEN_KEPT, FINDINGS, """steps AS (
  SELECT kind, id, 0 AS nth, text FROM corpus
  UNION ALL
  SELECT s.kind, s.id, s.nth + 1, CASE WHEN strpos(s.text, f.value) = 0 THEN s.text ELSE
    concat(left(s.text, strpos(s.text, f.value) - 1), f.placeholder, substring(s.text, strpos(s.text, f.value) + length(f.value))) END
  FROM steps s JOIN findings f ON f.kind = s.kind AND f.id = s.id AND f.nth = s.nth + 1)"""],
           "SELECT kind, id, CAST(max(nth) AS BIGINT) AS protected_count, arg_max(text, nth) AS redacted FROM steps GROUP BY kind, id"),
)
def screen_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = S.with_findings(load(spark, sf_dir, "corpus"))
    return done.select(
        "kind", "id", F.size("findings").cast("long").alias("protected_count"),
        S.screened_text(F.col("text"), F.col("findings")).alias("redacted"),
    )


@plan("warning_prompts", spaced(["corpus"], [], f"SELECT kind, id, regexp_matches(coalesce(text, ''), {re2(c.WARNING_WORDS, True)}) AS warning FROM corpus"))
def warning_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "corpus").select("kind", "id", S.is_warning(F.col("text")).alias("warning"))


@plan(
    "conversation_rollup",
    spaced(MESSAGES, [spans_ctes("messages", "conv_id, turn", c.SCREENING, ranked=False)],
           """SELECT m.conv_id, CAST(sum(coalesce(k.n, 0)) AS BIGINT) AS protected_count, count(*) FILTER (role <> 'system') AS message_count
FROM messages m LEFT JOIN (SELECT conv_id, turn, count(*) AS n FROM kept GROUP BY conv_id, turn) k ON k.conv_id = m.conv_id AND k.turn = m.turn GROUP BY m.conv_id"""),
)
def conversation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rollup(S.with_findings(messages(spark, sf_dir)))


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """Messages and vault of all conversations, committed as one version of a store."""
    folder = scratch_path(spark, "store")
    done = materialise(_redacted(spark, sf_dir))
    tables = {"messages": C.stored_messages(messages(spark, sf_dir), done), "vault": C.conversation_vault(done).drop("ord", "value")}
    N.commit(spark, folder, tables, {"messages": "conv_id", "vault": "conv_id"})
    return folder


@plan(
    "store_erased",
    spaced(MESSAGES, CHAT, f"""SELECT 'messages' AS kept_in, conv_id, count(*) AS n FROM messages m WHERE conv_id >= 8 AND (role <> 'user' OR {trim_sql('text')} <> '') GROUP BY conv_id
UNION ALL SELECT 'vault', conv_id, count(*) FROM chat_vault WHERE conv_id >= 8 GROUP BY conv_id"""),
)
def store_erased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after the first conversations were erased from messages and vault at once."""
    folder = _stored(spark, sf_dir)
    gone = messages(spark, sf_dir).where("conv_id < 8").select("conv_id")
    at, _anew, _left = N.erase(spark, folder, gone, "conv_id", ["messages", "vault"])
    count = lambda name: N.read(spark, folder, name, at).groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("kept_in", F.lit(name))
    return count("messages").unionByName(count("vault"))
