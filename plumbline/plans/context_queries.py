"""Context budgets, history, sessions, item confirmation, stores and fallback, over conversations, events and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import BLANKS, item_key, table_of, without_item
from ..operators import context, prefix, store
from ..operators.written import ItemTable
from ..sources.scratch import Scratch

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 4")
def o111_recent_messages(spark: SparkSession, d: str) -> DataFrame:
    return context.recent(table_of(spark, d, "conversations", "conv_id", "turn", "role"), "conv_id", "turn", 4)


HIST = """hist AS (SELECT conv_id, turn, used FROM (SELECT conv_id, turn, sum(length(role) + 2 + length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations WHERE role IN ('user', 'assistant')) WHERE used <= 3000)"""


@query(f"WITH {HIST} SELECT conv_id, turn, used::BIGINT AS used FROM hist")
def o105_history_budget(spark, d):
    return _history(spark, d).select("conv_id", "turn", "used")


def _history(spark, d) -> DataFrame:
    rows = table_of(spark, d, "conversations", "conv_id", "turn", "role", "text").where(F.col("role").isin("user", "assistant"))
    return context.within_budget(rows, "conv_id", "turn", F.length("role") + 2 + F.length("text") + 1, F.lit(3000))


DOCS = """docs AS (SELECT source, doc_id, n, used FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents) WHERE used <= 12000)"""


@query(f"WITH {DOCS} SELECT source, doc_id, used::BIGINT AS used FROM docs")
def o104_document_budget(spark, d):
    rows = table_of(spark, d, "documents", "source", "doc_id", (F.length("text") + 2).alias("cost"))
    return context.within_budget(rows, "source", "doc_id", F.col("cost"), F.lit(context.BUDGET), spread=True).select("source", "doc_id", "used")


@query(f"""WITH {DOCS}, left_ AS (SELECT source, 12000 - max(used) AS rest FROM docs GROUP BY source),
t AS (SELECT e.user_id % 20 AS s, event_id, event_type, sum(length(event_type) + length(props) + 1) OVER (PARTITION BY e.user_id % 20 ORDER BY event_id) AS used FROM events e)
SELECT source, event_id, used::BIGINT AS used FROM t JOIN left_ ON source = 'src' || s WHERE used <= rest""")
def o106_o107_chained_budgets(spark, d):
    """What documents leave of a source's budget goes to that source's facts (events dealt to sources)."""
    docs = o104_document_budget(spark, d).groupBy("source").agg((F.lit(context.BUDGET) - F.max("used")).alias("rest"))
    events = table_of(spark, d, "events", "event_id", "user_id", "event_type", "props")
    facts = events.select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source"), "event_id", (F.length("event_type") + F.length("props") + 1).alias("cost"))
    return context.within_budget(facts.join(docs, "source"), "source", "event_id", F.col("cost"), F.col("rest"), spread=True).select("source", "event_id", "used")


@query(f"WITH {DOCS} SELECT doc_id, '[' || n || '] [source=' || source || '] [chunk_id=' || doc_id || ']' AS header FROM docs")
def o129_citation_header(spark, d):
    docs = table_of(spark, d, "documents", "source", "doc_id", (F.length("text") + 2).alias("cost"))
    kept = prefix.running(docs, "source", "doc_id", n=F.lit(1), used=F.col("cost")).where(F.col("used") <= context.BUDGET)
    return kept.select("doc_id", context.citation(F.col("n"), source=F.col("source"), chunk_id=F.col("doc_id"), url=F.lit(None).cast("string")).alias("header"))


@query("SELECT p_partkey, concat_ws(chr(10), nullif(trim(p_type), ''), p_brand, p_name) AS embedding_text, p_name || chr(10) || p_brand AS hyde_text FROM part")
def o131_o132_embedding_text(spark, d):
    prefix = F.when(F.trim("p_type") != "", F.trim("p_type"))
    return table_of(spark, d, "part", "p_partkey", "p_type", "p_brand", "p_name").select("p_partkey", F.concat_ws("\n", prefix, "p_brand", "p_name").alias("embedding_text"), F.concat_ws("\n", "p_name", "p_brand").alias("hyde_text"))


@query("""SELECT conv_id, CASE WHEN count(*) FILTER (WHERE role = 'system') > 0 THEN 'search' WHEN count(*) FILTER (WHERE role = 'assistant') > 0 AND max(turn) % 4 = 0 THEN 'ask' WHEN count(*) FILTER (WHERE role = 'assistant') > 0 AND max(turn) % 4 < 2 THEN 'ask_again' ELSE 'degrade' END AS step FROM conversations GROUP BY conv_id""")
def o135_clarify_step(spark, d):
    each = table_of(spark, d, "conversations", "conv_id", "turn", "role").groupBy("conv_id").agg(F.count_if(F.col("role") == "system").alias("c"), F.count_if(F.col("role") == "assistant").alias("o"), (F.max("turn") % 4).alias("t"))
    return each.select("conv_id", context.clarify(F.col("c"), F.col("o"), F.col("t")).alias("step"))


@query("""SELECT conv_id, CASE WHEN contains(lower(q), 'item') THEN q ELSE q || ' item' || conv_id END AS rewritten FROM (SELECT conv_id, arg_max(text, turn) AS q FROM conversations WHERE role = 'user' GROUP BY conv_id)""")
def o136_locked_item(spark, d):
    last = table_of(spark, d, "conversations", "conv_id", "turn", "role", "text").where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("q"))
    return last.select("conv_id", F.when(F.contains(F.lower("q"), F.lit("item")), F.col("q")).otherwise(F.concat("q", F.lit(" item"), F.col("conv_id").cast("string"))).alias("rewritten"))


MATCHES = """m AS (SELECT DISTINCT c.c_mktsegment || (c.c_custkey % 40) AS name, 'Brand#' || ((c.c_custkey * 7) % 25) AS item, round(0.5 + ((c.c_custkey * 13) % 50) / 100.0, 2)::DOUBLE AS score FROM customer c UNION SELECT DISTINCT c_mktsegment || (c_custkey % 40), c_mktsegment || (c_custkey % 40), 0.9 FROM customer WHERE c_custkey % 97 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, item) AS n FROM m),
b AS (SELECT name, count(*) FILTER (WHERE score >= 0.7) AS highs, bool_or(name = item AND score >= 0.7) AS eq, arg_min(item, n) AS best, list(item ORDER BY n) FILTER (WHERE score >= 0.7 AND n <= 3) AS tops, list(item ORDER BY n) FILTER (WHERE score >= 0.6 AND n <= 3) AS seconds FROM r GROUP BY name),
k AS (SELECT name, CASE WHEN eq THEN name WHEN highs = 1 THEN best END AS confirmed, highs, tops, seconds FROM b)"""


def _matches(spark, d) -> DataFrame:
    """Stand-in scores of names against brands."""
    c = table_of(spark, d, "customer", "c_custkey", "c_mktsegment")
    name = F.concat("c_mktsegment", (F.col("c_custkey") % 40).cast("string"))
    scored = c.select(name.alias("name"), F.concat(F.lit("Brand#"), (F.col("c_custkey") * 7 % 25).cast("string")).alias("item"), F.round(0.5 + (F.col("c_custkey") * 13 % 50) / F.lit(100.0), 2).alias("score"))
    own = c.where("c_custkey % 97 = 0").select(name.alias("name"), name.alias("item"), F.lit(0.9).alias("score"))
    return scored.unionByName(own).distinct()


@query(f"WITH {MATCHES} SELECT name, confirmed, CASE WHEN confirmed IS NOT NULL THEN '' WHEN highs > 1 THEN coalesce(list_aggregate(tops, 'string_agg', '|'), '') ELSE coalesce(list_aggregate(seconds, 'string_agg', '|'), '') END AS options FROM k")
def o59_item_buckets(spark, d):
    return context.buckets(_matches(spark, d))


@query(f"WITH {MATCHES} SELECT name, item, score FROM (SELECT *, max(score) OVER (PARTITION BY name) AS best FROM m) WHERE round(best - score, 9) <= 0.15")
def o60_o91_score_gap(spark, d):
    return context.within_gap(_matches(spark, d), "name")


@query("""WITH s AS (SELECT source, doc_id, text, 2 * regexp_matches(text, '[A-Z]{2,}[0-9-]+')::INTEGER + (lang <> 'en')::INTEGER - 0.1 * (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS score, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE length(text) >= 10),
t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 6) DESC, i) AS n FROM s WHERE i <= 15),
u AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY i) AS k, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, text FROM t WHERE n <= 3)
SELECT source, k::INTEGER AS k, doc_id, substr(text, 1, (2500 - before)::BIGINT) AS sample FROM u WHERE before < 2500""")
def o72_o73_item_context(spark, d):
    """Of a source's first 15 chunks the three most telling, in their order, clipped to 2500 characters together."""
    w = Window.partitionBy("source")
    rows = table_of(spark, d, "documents", "source", "doc_id", "lang", "text").where(F.length("text") >= 10).withColumn("i", F.row_number().over(w.orderBy("doc_id"))).where("i <= 15")
    score = 2 * F.col("text").rlike("[A-Z]{2,}[0-9-]+").cast("int") + (F.col("lang") != "en").cast("int") - F.lit(0.1) * (F.col("i") - 1)
    best = rows.withColumn("n", F.row_number().over(w.orderBy(F.desc(F.round(score, 6)), "i"))).where("n <= 3")
    before = F.coalesce(F.sum(F.length("text")).over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = best.withColumns({"k": F.row_number().over(w.orderBy("i")), "before": before}).where("before < 2500")
    return placed.select("source", "k", "doc_id", F.substring("text", F.lit(1), (2500 - F.col("before")).cast("int")).alias("sample"))


@query(f"""WITH c AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, trim(regexp_replace(text, '^{BLANKS}+|{BLANKS}+$', '', 'g')) AS content, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS title, CASE WHEN lang = 'en' THEN 'mixed' ELSE lang END AS lang FROM documents),
p AS (SELECT *, 20 * regexp_matches(content, '[A-Za-z]{{1,}}[\\- ]?\\d{{2,}}[A-Za-z0-9\\-]*')::INTEGER + 10 * (title <> '' AND title <> source)::INTEGER + 10 * (lang <> 'mixed')::INTEGER - (i - 1) AS s FROM c WHERE i <= 15 AND length(content) >= 10),
b AS (SELECT source, i, '[切片]-' || i || '-' || content AS piece FROM p QUALIFY row_number() OVER (PARTITION BY source ORDER BY s DESC, i) <= 3),
u AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY source ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
v AS (SELECT source, substr(string_agg(piece, chr(10) || chr(10) ORDER BY i), 1, 2500) AS sample FROM u WHERE before <= 2500 GROUP BY source)
SELECT source, sample, substr(trim(regexp_replace('  "“' || source || '”「 ' || substr(sample, 1, 800) || ' ”"', '^{BLANKS}+|{BLANKS}+$', '', 'g'), '"“”「」'), 1, 150) AS prefix FROM v""")
def o72_o73_item_sample(spark, d):
    """The whole rule: titles, numbers before pieces, the budget; and a prefix without blanks and quotes at its ends."""
    rows = table_of(spark, d, "documents", "source", "doc_id", "lang", "text")
    title, lang = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.col("lang")), F.when(F.col("lang") == "en", "mixed").otherwise(F.col("lang"))
    chunks = rows.select("source", "doc_id", F.col("text").alias("content"), title.alias("title"), F.col("source").alias("file_title"), lang.alias("lang"))
    samples = context.item_context(chunks, "source", "doc_id")
    said = F.concat(F.lit('  "“'), "source", F.lit("”「 "), context.content_sample(F.col("sample")), F.lit(' ”"'))
    return samples.select("source", "sample", context.context_prefix(said).alias("prefix"))


TIERED = """h AS (SELECT l_orderkey AS query_id, l_partkey AS parent_uid, l_linenumber AS rank, l_quantity > 30 AS child, l_returnflag = 'R' AS item FROM lineitem),
t AS (SELECT query_id, parent_uid, rank, CASE WHEN child AND item THEN 1 WHEN child THEN 2 WHEN item THEN 3 ELSE 4 END AS tier FROM h),
tiers AS (SELECT query_id, parent_uid, rank, tier FROM t UNION ALL SELECT query_id, parent_uid, rank, 2 FROM t WHERE tier = 1 UNION ALL SELECT query_id, parent_uid, rank, 4 FROM t WHERE tier = 3)"""


@query(f"WITH {TIERED} SELECT query_id, parent_uid, rank, tier::INTEGER AS tier FROM (SELECT *, min(tier) OVER (PARTITION BY query_id) AS best FROM tiers) WHERE tier = best")
def o125_four_tiers(spark, d):
    """Children of the item, any children, parents of the item, any parents: the first of these that a query has hits in."""
    rows = table_of(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
    hits = rows.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("parent_uid"), F.col("l_linenumber").alias("rank"), (F.col("l_quantity") > 30).alias("child"), (F.col("l_returnflag") == "R").alias("item"))
    return store.fallback(hits.where("child"), hits.where("not child"), F.col("item")).drop("child", "item")


@query("SELECT vec_id, label, len(embedding)::INTEGER AS size, md5(coalesce(NULL::VARCHAR, vec_id::VARCHAR)) AS chunk_uid FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0")
def o18_validated_insert(spark, d):
    rows = store.valid(table_of(spark, d, "embeddings", "vec_id", "label", "embedding"), "embedding")
    return rows.select("vec_id", "label", F.size("embedding").alias("size"), store.filled(F.lit(None).cast("string"), F.md5(F.col("vec_id").cast("string").cast("binary"))).alias("chunk_uid"))


@query("SELECT p_partkey, p_brand, p_name, p_retailprice FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 3) UNION ALL SELECT p_partkey, p_brand, upper(p_name), p_retailprice FROM part WHERE p_size = 3")
def o19_o20_replace_by_item(spark, d):
    part = table_of(spark, d, "part", "p_partkey", "p_brand", "p_name", "p_retailprice", "p_size")
    new = part.where("p_size = 3").drop("p_size").withColumn("p_name", F.upper("p_name"))
    return store.replaced(part.drop("p_size"), new, "p_brand")


@query("SELECT event_id, coalesce(n.value, e.value) AS value FROM events e FULL JOIN (SELECT event_id + 5000 AS event_id, value * 2 AS value FROM events WHERE event_type = 'error') n USING (event_id)")
def o28_upsert(spark, d):
    events = table_of(spark, d, "events", "event_id", "value", "event_type")
    new = events.where("event_type = 'error'").select((F.col("event_id") + 5000).alias("event_id"), (F.col("value") * 2).alias("value"))
    return store.upserted(events.select("event_id", "value"), new, "event_id")


@query("""WITH s AS (SELECT p_partkey, p_brand, p_name, p_size FROM part), n AS (SELECT p_partkey + 1000000 AS p_partkey, p_brand, 'new ' || p_name AS p_name, p_size FROM part WHERE p_brand IN ('Brand#11', 'Brand#23') AND p_size > 25),
r AS (SELECT * FROM s WHERE p_brand NOT IN (SELECT p_brand FROM n) UNION ALL SELECT * FROM n),
u AS (SELECT p_partkey, p_brand, p_name, -p_size AS p_size FROM r WHERE p_brand = 'Brand#31' UNION ALL SELECT p_partkey + 2000000, p_brand, 'added', 0 FROM s WHERE p_brand = 'Brand#32')
SELECT p_partkey, p_brand, p_name, p_size FROM (SELECT * FROM r WHERE p_partkey NOT IN (SELECT p_partkey FROM u) UNION ALL SELECT * FROM u) WHERE p_brand <> 'Brand#44'""")
def o19_o20_o25_o28_written_table(spark, d):
    """A table in the shared folder keyed by brand: filled, two brands replaced, one upserted, one added to, one cleared; then read."""
    parts = table_of(spark, d, "part", "p_partkey", "p_brand", "p_name", "p_size")
    held = ItemTable(spark, f"{Scratch(spark, 'items').root}/parts", "p_partkey long, p_brand string, p_name string, p_size int", "p_brand", 16)
    held.replace(parts)
    held.replace(parts.where("p_brand in ('Brand#11', 'Brand#23') and p_size > 25").select((F.col("p_partkey") + 1_000_000).alias("p_partkey"), "p_brand", F.concat(F.lit("new "), "p_name").alias("p_name"), "p_size"))
    held.upsert(held.of(parts.where("p_brand = 'Brand#31'")).withColumn("p_size", -F.col("p_size")), "p_partkey")
    held.upsert(parts.where("p_brand = 'Brand#32'").select((F.col("p_partkey") + 2_000_000).alias("p_partkey"), "p_brand", F.lit("added").alias("p_name"), F.lit(0).alias("p_size")), "p_partkey")
    held.clear(parts.where("p_brand = 'Brand#44'"))
    return held.rows()


@query("SELECT conv_id, turn, CASE WHEN coalesce(trim(CASE WHEN turn % 2 = 0 THEN role END), '') = '' THEN 'item' || conv_id ELSE role END AS item_names FROM conversations")
def o141_backfill(spark, d):
    known = F.when(F.col("turn") % 2 == 0, F.col("role"))
    return table_of(spark, d, "conversations", "conv_id", "turn", "role").select("conv_id", "turn", store.filled(F.trim(known), F.concat(F.lit("item"), F.col("conv_id").cast("string"))).alias("item_names"))


@query("SELECT item, name, arg_min(chunk_id, k) AS source_chunk_id, substr(arg_min(ctx, k), 1, 200) AS context FROM (SELECT p_brand AS item, p_name AS name, p_partkey AS chunk_id, p_partkey AS k, repeat(p_type || ' ', 40) AS ctx FROM part) GROUP BY item, name")
def o23_entity_names(spark, d):
    rows = table_of(spark, d, "part", "p_partkey", "p_brand", "p_name", "p_type").groupBy(F.col("p_brand").alias("item"), F.col("p_name").alias("name")).agg(F.min(F.struct("p_partkey", "p_type")).alias("f"))
    return rows.select("item", "name", F.col("f.p_partkey").alias("source_chunk_id"), F.substring(F.repeat(F.concat("f.p_type", F.lit(" ")), 40), 1, 200).alias("context"))


HITS = """hits AS (SELECT l_orderkey AS query_id, l_partkey AS parent_uid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS rank FROM lineitem)"""


def _hits(spark, d) -> DataFrame:
    rows = table_of(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    return rows.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("parent_uid"), "l_returnflag", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey")).alias("rank"))


@query(f"WITH {HITS} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY best, chunk_id)::INTEGER AS rank FROM (SELECT query_id, p_brand AS chunk_id, min(rank) AS best FROM hits JOIN part ON p_partkey = parent_uid GROUP BY 1, 2)")
def o74_parent_lookup(spark, d):
    """Children: order lines; parents: the part's brand."""
    return store.parents(_hits(spark, d), table_of(spark, d, "part", F.col("p_partkey").alias("chunk_uid"), F.col("p_brand").alias("chunk_id")))


@query("""WITH h AS (SELECT l_orderkey AS query_id, l_partkey AS parent_uid, l_returnflag FROM lineitem),
a AS (SELECT query_id, parent_uid, 1 AS tier FROM h WHERE l_returnflag = 'R' UNION ALL SELECT query_id, parent_uid, 2 FROM h WHERE l_returnflag = 'A' UNION ALL SELECT query_id, parent_uid, 3 FROM h)
SELECT query_id, parent_uid, tier FROM (SELECT *, min(tier) OVER (PARTITION BY query_id) AS m FROM a) WHERE tier = m""")
def o125_fallback_tiers(spark, d):
    h = _hits(spark, d).select("query_id", "parent_uid", "l_returnflag")
    tier = lambda c: h.where(c).drop("l_returnflag")
    return store.first_with_rows([tier("l_returnflag = 'R'"), tier("l_returnflag = 'A'"), h.drop("l_returnflag")])


@query("SELECT user_id, event_id, (count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW))::BIGINT AS in_window, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) > 4 AS waits FROM events")
def o110_rate_window(spark, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0)
    rows = table_of(spark, d, "events", "user_id", "event_id", "ts").withColumn("us", micros)
    return rows.select("user_id", "event_id", F.count("*").over(w).alias("in_window"), (F.count("*").over(w) > 4).alias("waits"))


@query("""SELECT user_id AS task_id, list_aggregate(list_sort(list_distinct(list(event_type) FILTER (WHERE event_type IN ('click', 'view')))), 'string_agg', ',') AS done, CASE arg_max(event_type, event_id) FILTER (WHERE event_type IN ('error', 'purchase')) WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'processing' END AS status FROM events GROUP BY user_id""")
def o137_task_progress(spark, d):
    """The batch twin of the streaming state: nodes done, and the last status."""
    e = table_of(spark, d, "events", "user_id", "event_id", "event_type")
    last = F.max(F.when(F.col("event_type").isin("error", "purchase"), F.struct("event_id", "event_type")))["event_type"]
    each = e.groupBy(F.col("user_id").alias("task_id")).agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("event_type").isin("click", "view"), F.col("event_type")))), ",").alias("done"), last.alias("last"))
    return each.select("task_id", F.nullif("done", F.lit("")).alias("done"), F.when(F.col("last") == "error", "failed").when(F.col("last") == "purchase", "completed").otherwise("processing").alias("status"))


@query("SELECT user_id AS task_id, max(ts) AS last_seen FROM events GROUP BY user_id HAVING max(ts) > (SELECT max(ts) - INTERVAL 2 HOUR FROM events)")
def o138_ttl_prune(spark, d):
    e = table_of(spark, d, "events", "user_id", "ts")
    now = F.broadcast(e.agg((F.max("ts") - F.expr("INTERVAL 2 HOURS")).alias("limit")))
    return e.groupBy(F.col("user_id").alias("task_id")).agg(F.max("ts").alias("last_seen")).join(now, F.col("last_seen") > F.col("limit")).drop("limit")


@query("SELECT user_id AS session_id, event_id AS asked_at, event_type AS options FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type IN ('click', 'view', 'signup')) WHERE n = 1 AND event_type <> 'signup'")
def o140_session_slots(spark, d):
    """The open slot of every session: the last click or view, unless a later signup cleared it."""
    e = table_of(spark, d, "events", "user_id", "event_id", "event_type").where(F.col("event_type").isin("click", "view", "signup"))
    last = e.groupBy(F.col("user_id").alias("session_id")).agg(F.max(F.struct("event_id", "event_type")).alias("l"))
    return last.where("l.event_type <> 'signup'").select("session_id", F.col("l.event_id").alias("asked_at"), F.col("l.event_type").alias("options"))


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS n FROM documents) WHERE n = 1")
def o14_newest_per_title(spark, d):
    """The newest export of each title (here the largest of each source): a map-side maximum."""
    docs = table_of(spark, d, "documents", "source", "doc_id", "n_chars")
    return docs.groupBy("source").agg(F.max(F.struct("n_chars", "doc_id")).alias("m")).select("source", "m.doc_id", "m.n_chars")


@query("""SELECT p_partkey, trim(regexp_replace('how does  the' || CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE '' END || ' ' || p_type || '\t work', '\\s+', ' ', 'g')) AS question FROM part""")
def o66_question_without_item(spark, d):
    """An item's brand and name taken out of a question that writes it in capitals and with other blanks; another item's stay."""
    item = F.concat("p_brand", F.lit(" "), "p_name")
    told = F.upper(F.concat(F.lit(" "), F.regexp_replace(item, "(?<=[A-Za-z])(?=[A-Za-z#0-9])|#", "$0 ")))
    rest = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise("")
    question = F.concat(F.lit("how does "), told, F.lit("  the"), rest, F.lit(" "), "p_type", F.lit("\t work"))
    return table_of(spark, d, "part", "p_partkey", "p_brand", "p_name", "p_type").select("p_partkey", without_item(question, item).alias("question"))


@query("SELECT p_partkey, list_aggregate(list_distinct([lower(p_brand), lower(p_type)]), 'count') AS names, lower(p_brand) AS first_name FROM part")
def o62_entity_list(spark, d):
    """Names out of a JSON list: trimmed to 15 characters, empty ones and repeats left out, order kept."""
    payload = F.to_json(F.array("p_brand", F.lit("  "), "p_type", "p_brand"))
    names = F.transform(F.from_json(payload, "array<string>"), lambda x: F.substring(item_key(F.trim(x)), 1, 15))
    clean = F.array_distinct(F.filter(names, lambda x: x != ""))
    return table_of(spark, d, "part", "p_partkey", "p_brand", "p_type").select("p_partkey", F.size(clean).cast("long").alias("names"), clean[0].alias("first_name"))
