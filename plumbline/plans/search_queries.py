"""Search, fusion, rerank, gate and evaluation queries: questions are benchmark texts, the corpus is documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import BLANKS, table_of
from ..operators import ivf, models, postings, ranking, search
from ..sources.scratch import Scratch

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


DENSE = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_inner_product(a.e, b.e), 6) AS score FROM u a, u b WHERE a.vec_id % 20 = 0) QUALIFY rank <= 5)"""


def _dense(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    rows = table_of(spark, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.dense_hits(rows.where("id % 20 = 0"), rows, k)


@query(f"WITH {DENSE} SELECT query_id, id, score, rank::INTEGER AS rank FROM dense")
def o112_dense_topk(spark, d):
    """The stated query set (every vector whose id is divisible by 20) against all vectors."""
    return _dense(spark, d)


@query()
def o80_o112_ivf_topk(spark, d):
    """The same queries by inverted lists: 64 lists, 30 of them probed, as these vectors are nearly random (recall 0.92 and more)."""
    rows = table_of(spark, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return ivf.hits(ivf.indexed(rows, 64), rows.where("id % 20 = 0"), probes=30)


TOKENS = """dt AS (SELECT id, token, count(*) AS w FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')) AS token FROM documents) GROUP BY 1, 2),
qt AS (SELECT id, token, count(*) AS w FROM (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')) AS token FROM benchmark) GROUP BY 1, 2),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.id AS query_id, t.id, sum(q.w * t.w)::DOUBLE AS score FROM qt q JOIN dt t USING (token) GROUP BY 1, 2) QUALIFY rank <= 5)"""


def _asked(spark, d) -> DataFrame:
    return search.token_counts(table_of(spark, d, "benchmark", "item_id", "text"), "item_id", "text")


def _index(spark, d) -> postings.Postings:
    return postings.indexed_texts(table_of(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@query(f"WITH {TOKENS} SELECT query_id, id, score, rank::INTEGER AS rank FROM sparse")
def o113_sparse_topk(spark, d):
    return postings.search(_index(spark, d), _asked(spark, d)).hits


LABELS = """near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, (10 - abs(a.label - b.label))::DOUBLE AS score FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 20 = 0) QUALIFY rank <= 5)"""


@query(f"""WITH {DENSE}, {LABELS},
m AS (SELECT query_id, id, max(CASE WHEN leg = 0 THEN x END) AS a, max(CASE WHEN leg = 1 THEN x END) AS b FROM (SELECT query_id, id, (1 + score) / 2 AS x, 0 AS leg FROM dense UNION ALL SELECT query_id, id, 0.5 + atan(score) / 3.141592653589793e0, 1 FROM near) GROUP BY 1, 2),
s AS (SELECT query_id, id, round(0.5 * coalesce(a, 0.0) + 0.5 * coalesce(b, 0.0), 6)::DOUBLE AS score FROM m)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= 5""")
def o114_hybrid_weighted(spark, d):
    """Dense hits fused with hits by label (a stand-in for the sparse leg, which has no link to vectors)."""
    rows = table_of(spark, d, "embeddings", "vec_id", "label")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    # equal labels score alike, so the five smallest ids of a label are its hits
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("n <= 5")
    near = asked.join(first, "label").select("query_id", F.col("vec_id").alias("id"), F.lit(10.0).alias("score"), F.col("n").alias("rank"))
    return search.weighted(_dense(spark, d), near)


SPARSE = f"""words AS (SELECT id, ('0x' || substr(md5(token), 1, 6))::INTEGER AS token, sum(w) AS c FROM dt GROUP BY 1, 2), lns AS (SELECT id, token, ln(1 + c) AS weight FROM words),
norms AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM lns GROUP BY id), sv AS (SELECT id, token, round(weight / norm, 6) AS weight FROM lns JOIN norms USING (id))"""


@query(f"WITH {TOKENS}, {SPARSE} SELECT id AS doc_id, count(*) AS terms, sum(round(weight * 1000000)::BIGINT)::BIGINT AS millionths, sum(token::BIGINT)::BIGINT AS tokens FROM sv GROUP BY id")
def o147_sparse_embeddings(spark, d):
    """Sparse vectors of documents as maps, told by their size and sums."""
    vectors = models.sparse_embeddings(table_of(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    millionths = F.transform(F.map_values("vector"), lambda w: F.round(w * 1_000_000).cast("long"))
    return vectors.select("doc_id", F.size("vector").cast("long").alias("terms"), total(millionths).alias("millionths"), total(F.map_keys("vector")).alias("tokens"))


@query(f"""WITH {DENSE}, {TOKENS}, {SPARSE}, corpus AS (SELECT sv.* FROM sv JOIN embeddings ON vec_id = id),
other AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.id AS query_id, c.id, round(sum(q.weight * c.weight), 6) AS score FROM corpus q JOIN corpus c USING (token) WHERE q.id % 20 = 0 GROUP BY 1, 2) QUALIFY rank <= 5),
m AS (SELECT query_id, id, max(CASE WHEN leg = 0 THEN x END) AS a, max(CASE WHEN leg = 1 THEN x END) AS b FROM (SELECT query_id, id, (1 + score) / 2 AS x, 0 AS leg FROM dense UNION ALL SELECT query_id, id, 0.5 + atan(score) / 3.141592653589793e0, 1 FROM other) GROUP BY 1, 2),
s AS (SELECT query_id, id, round(0.5 * coalesce(a, 0.0) + 0.5 * coalesce(b, 0.0), 6)::DOUBLE AS score FROM m)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= 5""")
def o114_hybrid_dense_sparse(spark, d):
    """Documents that have an embedding: cosine of embeddings and inner product of sparse vectors, searched apart and fused by weight."""
    docs = table_of(spark, d, "documents", "doc_id", "text").join(table_of(spark, d, "embeddings", F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    scratch = Scratch(spark, "hybrid")
    vectors = models.sparse_embeddings(docs, "doc_id", "text").select(F.col("doc_id").alias("id"), F.map_keys("vector").alias("tokens"), F.map_values("vector").alias("weights"))
    rows = scratch.put(vectors, "vectors")
    # whole documents share tokens with nearly all others, so products by packs take less than an index
    return search.weighted(_dense(spark, d), search.vector_hits(rows.where("id % 20 = 0"), rows, scratch))


# Legs of a question: sparse hits; documents with most of its least shingles; documents of the sources of sparse hits.
LEGS = f"""{TOKENS},
lt AS (SELECT id, token FROM (SELECT id, token, row_number() OVER (PARTITION BY id ORDER BY length(token) DESC, token) AS n FROM qt) WHERE n <= 8),
long AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.id AS query_id, t.id, count(*)::DOUBLE AS score FROM lt q JOIN dt t USING (token) GROUP BY 1, 2) QUALIFY rank <= 5),
src AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents QUALIFY n <= 5),
kg AS (SELECT query_id, doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY sup DESC, doc_id) AS rank FROM (SELECT query_id, source, count(*) AS sup FROM sparse JOIN documents ON doc_id = id GROUP BY 1, 2) JOIN src USING (source) QUALIFY rank <= 5),
legs AS (SELECT query_id, 'vector' AS leg, rank, id FROM sparse UNION ALL SELECT query_id, 'hyde', rank, id FROM long UNION ALL SELECT query_id, 'kg', rank, id FROM kg)"""
FUSED = f"""{LEGS},
w AS (SELECT query_id, id, min(rank) FILTER (WHERE leg = 'vector') AS a, min(rank) FILTER (WHERE leg = 'hyde') AS b, min(rank) FILTER (WHERE leg = 'kg') AS c FROM legs GROUP BY 1, 2),
f AS (SELECT *, round(coalesce(1.0e0 / (a + 60), 0) + coalesce(1.0e0 / (b + 60), 0) + coalesce(0.7e0 / (c + 60), 0), 9) AS score FROM w),
fused AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(a, 1073741824), coalesce(b, 1073741824), coalesce(c, 1073741824), id) AS rank FROM f QUALIFY rank <= 10)"""


def _legs(spark, d, index: postings.Postings | None = None) -> DataFrame:
    asked, index = _asked(spark, d), index or _index(spark, d)
    docs = table_of(spark, d, "documents", "doc_id", "source")
    sparse = postings.search(index, asked).hits
    longest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.length("token")), "token"))
    telling = asked.withColumn("n", longest).where("n <= 8").select(F.col("id").alias("query_id"), "token")
    telling = postings.broadcast_if_few(telling, Scratch(spark, "legs"), "telling")
    counted = index.rows.join(telling, "token").select("query_id", F.inline("postings")).groupBy("query_id", "id").agg(F.count("*").cast("double").alias("score"))
    long = search.top_k(counted, 5)
    first = docs.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("n <= 5")
    support = sparse.join(docs, sparse.id == docs.doc_id).groupBy("query_id", "source").agg(F.count("*").cast("double").alias("score"))
    kg = search.top_k(support.join(first, "source").select("query_id", F.col("doc_id").alias("id"), "score"), 5)
    leg = lambda df, name: df.select("query_id", F.lit(name).alias("leg"), "rank", "id")
    return leg(sparse, "vector").unionByName(leg(long, "hyde")).unionByName(leg(kg, "kg"))


@query(f"WITH {LEGS} SELECT query_id, leg, rank::INTEGER AS rank, id FROM legs")
def o99_o143_leg_ranks(spark, d):
    return _legs(spark, d)


@query(f"WITH {FUSED} SELECT query_id, id, score, rank::INTEGER AS rank FROM fused")
def o115_rrf_top10(spark, d):
    return ranking.fused(_legs(spark, d))


@query(f"WITH {FUSED.replace('QUALIFY rank <= 10', '')} SELECT query_id, id, score, rank::INTEGER AS rank FROM fused")
def o87_rrf_all(spark, d):
    return ranking.fused(_legs(spark, d), top=0)


@query(f"""WITH {FUSED}, told AS (SELECT query_id, legs.id, CASE leg WHEN 'vector' THEN 1 WHEN 'hyde' THEN 2 ELSE 3 END AS place, leg, rank, source FROM legs JOIN documents ON doc_id = legs.id),
first AS (SELECT query_id, id, leg || ':' || rank AS content, source AS title FROM told QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY place, rank) = 1)
SELECT query_id, id, score, rank::INTEGER AS rank, content, title FROM fused JOIN first USING (query_id, id)""")
def o81_fused_payload(spark, d):
    """Fused hits with the content and title that the first leg gave them."""
    docs = table_of(spark, d, "documents", F.col("doc_id").alias("id"), F.col("source").alias("title"))
    legs = _legs(spark, d).join(docs, "id").withColumn("content", F.concat("leg", F.lit(":"), F.col("rank").cast("string")))
    return ranking.fused(legs, payload=("content", "title"))


# Rerank: the share of a question's distinct tokens that the document has, scaled to the range of the gate.
RERANKED = f"""{FUSED},
ov AS (SELECT query_id, f.id, count(t.token) AS hit FROM fused f JOIN qt q ON q.id = f.query_id LEFT JOIN dt t ON t.id = f.id AND t.token = q.token GROUP BY 1, 2),
qn AS (SELECT id AS query_id, count(*) AS n FROM qt GROUP BY 1),
rr AS (SELECT query_id, id, round(12.0e0 * hit / n - 7, 6) AS score FROM ov JOIN qn USING (query_id)),
reranked AS (SELECT rr.query_id, rr.id, rr.score, row_number() OVER (PARTITION BY rr.query_id ORDER BY rr.score DESC, fused.rank) AS rank FROM rr JOIN fused USING (query_id, id))"""


def _reranked(spark, d, index: postings.Postings | None = None) -> DataFrame:
    """The fused hits by the share of the question's distinct tokens that the document has, counted in the texts themselves."""
    words = lambda c: F.array_distinct(search.tokens(F.col(c)))
    q = table_of(spark, d, "benchmark", F.col("item_id").alias("query_id"), "text").select("query_id", words("text").alias("asked"))
    candidates = Scratch(spark, "fused").put(ranking.fused(_legs(spark, d, index)), "fused")
    docs = table_of(spark, d, "documents", F.col("doc_id").alias("id"), "text")
    found = docs.join(candidates.join(q, "query_id"), "id").select("query_id", "id", "rank", F.size("asked").alias("n"), F.size(F.array_intersect("asked", words("text"))).alias("hit"))
    scored = found.select("query_id", "id", F.round(F.lit(12.0) * F.col("hit") / F.col("n") - 7, 6).alias("score"), F.col("rank").alias("before"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "before"))
    return scored.withColumn("rank", rank).drop("before")


@query(f"WITH {RERANKED} SELECT query_id, id, score, rank::INTEGER AS rank FROM reranked")
def o116_o149_rerank(spark, d):
    return _reranked(spark, d)


CLIFF = f"""{RERANKED},
g AS (SELECT *, score - lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS gap, lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS nxt, least(10, count(*) OVER (PARTITION BY query_id)) AS ub FROM reranked),
h AS (SELECT *, min(CASE WHEN rank >= least(3, ub) AND rank < ub AND (gap >= 0.5 OR gap / greatest(abs(score), abs(nxt), 1e-6) >= 0.25) THEN rank END) OVER (PARTITION BY query_id) AS cut FROM g),
cliff AS (SELECT query_id, id, score, rank FROM h WHERE rank <= coalesce(cut, ub))"""


@query(f"WITH {CLIFF} SELECT query_id, id, score, rank::INTEGER AS rank FROM cliff")
def o100_cliff_cutoff(spark, d):
    return ranking.cliff_cut(_reranked(spark, d))


@query(f"WITH {CLIFF} SELECT item_id AS query_id, score AS top_score, CASE WHEN score IS NULL OR score < 0 THEN 'fallback' WHEN score < 2 THEN 'notice' ELSE 'answer' END AS decision FROM benchmark LEFT JOIN cliff ON query_id = item_id AND rank = 1")
def o133_answer_gate(spark, d):
    return ranking.gated(table_of(spark, d, "benchmark", F.col("item_id").alias("query_id")), ranking.cliff_cut(_reranked(spark, d)))


TRUTH = """truth AS (SELECT item_id AS query_id, list(doc_id) AS expected FROM benchmark JOIN documents ON contains(documents.text, benchmark.text) GROUP BY 1)"""
METRICS = f"""{CLIFF}, {TRUTH},
got AS (SELECT t.query_id, len(expected) AS wanted, c.rank, (list_contains(expected, c.id))::INTEGER AS gain FROM truth t LEFT JOIN cliff c ON c.query_id = t.query_id AND c.rank <= 5),
m AS (SELECT query_id, any_value(wanted) AS wanted, {", ".join(f"coalesce(max(gain) FILTER (WHERE rank <= {k}), 0)::DOUBLE AS hit_{k}, round(coalesce(sum(gain) FILTER (WHERE rank <= {k}), 0) / any_value(wanted), 6)::DOUBLE AS recall_{k}" for k in (1, 3, 5))},
round(coalesce(1.0e0 / min(rank) FILTER (WHERE gain > 0), 0), 6) AS mrr, sum(gain / log2(rank + 1)) AS dcg, sum(gain) AS n FROM got GROUP BY query_id),
e AS (SELECT * EXCLUDE (wanted, dcg, n), round(coalesce(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, n::BIGINT + 1), lambda i: 1 / log2(i + 1))) END, 0), 6)::DOUBLE AS ndcg FROM m)"""


#: Questions without an inner token that all documents meet at once, and bytes of such questions that are broadcast.
BLOCK, BROADCAST_BYTES = 256, 16 << 20


def _containing(spark, items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id) by contains alone: each block of items meets all documents, where they lie if the items are few, in slices beyond."""
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = -(-n // BLOCK)
    if not n:
        return docs.limit(0).select(F.lit(None).cast("long").alias("item_id"), "doc_id")
    asked = items.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("item_id", "text")).alias("asked"))
    rows = docs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    if size <= BROADCAST_BYTES:
        met = rows.join(F.broadcast(asked), "block")
    else:
        slices = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        asked = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        met = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int")).join(asked, ["block", "slice"])
    found = met.select("doc_id", F.filter("asked", lambda x: F.contains(F.col("body"), x["text"])).alias("found"))
    return found.select(F.explode("found.item_id").alias("item_id"), "doc_id")


def _cases(spark, d, index: postings.Postings | None = None) -> DataFrame:
    """(query_id, id) of questions and documents that contain their text.

    Candidates meet by the question's longest inner token, so no text meets all others; questions of one or
    two tokens have none and are looked for in every document.
    """
    index = index or _index(spark, d)
    items, docs = table_of(spark, d, "benchmark", "item_id", "text").where("text is not null"), table_of(spark, d, "documents", "doc_id", F.col("text").alias("body"))
    tokens = search.tokens(F.col("text"))
    # the first and last tokens may be parts of longer ones in a document
    inner = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 2, F.lit(0)))
    keyed = items.withColumn("token", F.reduce(inner, F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a)))
    met = index.rows.join(keyed.where("token <> ''"), "token").select("item_id", "text", F.explode("postings.id").alias("doc_id"))
    long = met.join(docs, "doc_id").where(F.contains("body", "text")).select("item_id", "doc_id")
    return long.unionByName(_containing(spark, keyed.where("token = ''").drop("token"), docs)).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("id"))


@query(f"WITH {METRICS} SELECT * FROM e")
def o101_o103_case_metrics(spark, d):
    index = _index(spark, d)
    pairs = Scratch(spark, "cases").put(_cases(spark, d, index), "pairs")
    return ranking.pair_metrics(pairs.groupBy("query_id").agg(F.count("*").alias("wanted")), pairs, ranking.cliff_cut(_reranked(spark, d, index)))


@query(f"WITH {METRICS} SELECT count(*) AS cases, {', '.join(f'round(avg({c}), 6) AS {c}' for c in ('hit_1', 'hit_3', 'hit_5', 'recall_1', 'recall_3', 'recall_5', 'mrr', 'ndcg'))} FROM e")
def o96_eval_summary(spark, d):
    each = o101_o103_case_metrics(spark, d)
    return each.agg(F.count("*").alias("cases"), *(F.round(F.avg(c), 6).alias(c) for c in each.columns if c != "query_id"))


@query(f"WITH {TRUTH}, t AS (SELECT item_id, coalesce(len(expected), 0) AS n FROM benchmark LEFT JOIN truth ON query_id = item_id) SELECT CASE WHEN n = 0 THEN 'negative' WHEN n = 1 THEN 'one' ELSE 'several' END AS category, count(*) AS cases FROM t GROUP BY 1")
def o98_case_categories(spark, d):
    kind = F.when(F.col("n").isNull(), "negative").when(F.col("n") == 1, "one").otherwise("several")
    items = table_of(spark, d, "benchmark", F.col("item_id").alias("query_id"))
    return items.join(_cases(spark, d).groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").groupBy(kind.alias("category")).agg(F.count("*").alias("cases"))


@query(f"""WITH {RERANKED},
web AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
l AS (SELECT 'local' AS origin, id AS chunk_id, NULL::VARCHAR AS url, NULL::VARCHAR AS title, query_id FROM reranked)
SELECT origin, chunk_id, url, title, query_id FROM l UNION ALL SELECT 'web', NULL, url, title, NULL FROM web WHERE trim(title) <> ''""")
def o120_source_union(spark, d):
    local = _reranked(spark, d).select(F.lit("local").alias("origin"), F.col("id").alias("chunk_id"), "query_id")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    web = table_of(spark, d, "pages", "url", "html").select(F.lit("web").alias("origin"), "url", title.alias("title")).where(F.trim("title") != "")
    return local.unionByName(web, allowMissingColumns=True).select("origin", "chunk_id", "url", "title", "query_id")


@query(f"""WITH u AS (SELECT 'local' AS origin, regexp_replace(text, '^{BLANKS}+|{BLANKS}+$', '', 'g') AS content, source AS title, doc_id AS chunk_id, NULL::VARCHAR AS url FROM documents
UNION ALL SELECT 'web', coalesce(nullif(CASE WHEN page_id % 3 = 0 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END, ''), CASE WHEN page_id % 3 = 1 THEN '' ELSE trim(url) END), regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '^{BLANKS}+|{BLANKS}+$', '', 'g'), NULL, trim(url) FROM pages)
SELECT origin, md5(content) AS content_md5, title, chunk_id, url FROM u WHERE content <> ''""")
def o120_content_union(spark, d):
    """Documents, and pages with their title as content, else the address as snippet, else nothing."""
    local = table_of(spark, d, "documents", F.col("text").alias("content"), F.col("source").alias("title"), F.col("doc_id").alias("chunk_id"))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    web = table_of(spark, d, "pages", "page_id", "url", "html").select(F.when(F.col("page_id") % 3 == 0, title).alias("content"), F.when(F.col("page_id") % 3 == 1, "  ").otherwise(F.concat("url", F.lit(" "))).alias("snippet"), title.alias("title"), "url")
    return search.united(local, web).select("origin", F.md5(F.col("content").cast("binary")).alias("content_md5"), "title", "chunk_id", "url")
