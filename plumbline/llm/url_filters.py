"""9. URL filters: explicit rules, and for the rest a ratio of two character language models.

Accepted and rejected URLs (as the rules judge them) each train a variable-order Markov model: the chance
of a character after its last ORDER characters is smoothed by that after fewer, down to a uniform one. A
URL's score is the difference of the two log-likelihoods divided by its length, and the threshold lies
between the two classes' own scores. DataFrame functions only; what meets by a shuffle is keyed by
character runs, of which the very common ones are broadcast (under HEAVY of them, whatever the input).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, heavy_join, table

ORDER = 3
#: Weight of the shorter context, in observations.
PRIOR = 2.0
SYMBOLS = 256
#: Characters of a URL that are looked at as one string.
PIECE = 1000
#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for no "://"."""
    rest = F.when(url.contains("://"), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per row of pages: id_col, host, path, rule, verdict.

    A URL without rule is allowed if its score reaches the threshold. Null URLs, URLs without "://" and
    empty host and path have no characters: allowed, as is every URL while one class has no example.
    Repeated rows count and are returned as often as they come. No rows in: no rows out. A URL of any length is
    judged by all its characters, in time linear in them. Other columns of pages are not looked at.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.select("id", "host", "path", "r.rule", F.col("r.verdict").alias("ruled"))
    # equal host and path are judged once, however often they come
    urls = scratch.put(rows.groupBy("host", "path", "ruled").agg(F.count("*").alias("times")).withColumn("url", F.monotonically_increasing_id()), "urls")
    text = F.concat(F.lit("^" * ORDER), "host", "path")
    # a place in a string is found from its start, so long URLs are first cut into pieces that overlap by a context
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{PIECE + ORDER}}})).{{1,{PIECE}}}"), F.lit(1))
    cut = urls.where("host <> '' or path <> ''").select("url", "ruled", "times", F.explode(pieces).alias("piece")).where(F.length("piece") > ORDER)
    spots = F.explode(F.sequence(F.lit(1), F.length("piece") - ORDER))
    runs = cut.select("url", "ruled", "times", "piece", spots.alias("i")).select("url", "ruled", "times", F.substring("piece", F.col("i"), F.lit(ORDER + 1)).alias("run"))
    count = lambda verdict: F.sum(F.when(F.col("ruled") == verdict, F.col("times")).otherwise(0))
    seen = scratch.put(runs.groupBy("run").agg(count("allow").alias("na"), count("block").alias("nb"), F.count("*").alias("weight")), "runs")

    model = seen.withColumns({"pa": F.lit(1.0 / SYMBOLS), "pb": F.lit(1.0 / SYMBOLS)})
    for order in range(ORDER + 1):
        tail = F.substring("run", ORDER + 1 - order, order + 1)
        context = F.substring("run", ORDER + 1 - order, order)
        sums = lambda key, a, b: seen.groupBy(key.alias("key")).agg(F.sum("na").alias(a), F.sum("nb").alias(b))
        for key, a, b in ((tail, "ga", "gb"), (context, "ca", "cb")):
            model = model.withColumn("key", key).join(sums(key, a, b), "key").drop("key")
        smooth = lambda g, c, p: (F.col(g) + PRIOR * F.col(p)) / (F.col(c) + PRIOR)
        model = model.withColumns({"pa": smooth("ga", "ca", "pa"), "pb": smooth("gb", "cb", "pb")}).drop("ga", "gb", "ca", "cb")
    model = scratch.put(model.select(F.xxhash64("run").alias("key"), (F.log("pa") - F.log("pb")).alias("llr"), "weight"), "model")

    scores = heavy_join(runs.select("url", F.xxhash64("run").alias("key")), model, "key", "weight").groupBy("url").agg(F.avg("llr").alias("score"))
    scores = scratch.put(scores, "scores")
    class_of = urls.where("ruled is not null").select("url", "ruled", "times").join(scores, "url")
    stat = lambda f, verdict: f(F.when(F.col("ruled") == verdict, F.col("score")))
    spread = lambda verdict: F.coalesce(stat(F.stddev_pop, verdict), F.lit(0.0)) + 1e-9
    limit = class_of.agg(stat(F.avg, "allow").alias("ma"), stat(F.avg, "block").alias("mb"), spread("allow").alias("sa"), spread("block").alias("sb"))
    limit = limit.select(((F.col("ma") * F.col("sb") + F.col("mb") * F.col("sa")) / (F.col("sa") + F.col("sb"))).alias("limit"))

    verdicts = urls.where("ruled is null").select("url", "host", "path").join(scores, "url").join(F.broadcast(limit))
    verdicts = verdicts.select("host", "path", F.when(F.col("score") < F.col("limit"), "block").otherwise("allow").alias("learned"))
    out = rows.join(verdicts, ["host", "path"], "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", "learned", F.lit("allow")).alias("verdict"))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages", "page_id", "url"))


def _oracle() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{v if what else h + p}'" for v, h, p in rules) + " END"
    levels, last = [], f"SELECT run, na, nb, 1.0e0 / {SYMBOLS} AS pa, 1.0e0 / {SYMBOLS} AS pb FROM seen"
    for o in range(ORDER + 1):
        tail, ctx = f"substr(run, {ORDER + 1 - o}, {o + 1})", f"substr(run, {ORDER + 1 - o}, {o})"
        levels.append(f"m{o} AS (SELECT run, na, nb, (sum(na) OVER (PARTITION BY {tail}) + {PRIOR} * pa) / (sum(na) OVER (PARTITION BY {ctx}) + {PRIOR}) AS pa, (sum(nb) OVER (PARTITION BY {tail}) + {PRIOR} * pb) / (sum(nb) OVER (PARTITION BY {ctx}) + {PRIOR}) AS pb FROM ({last}))")
        last = f"SELECT * FROM m{o}"
    return f"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, {case(0)} AS rule, {case(1)} AS ruled FROM b),
runs AS (SELECT page_id, ruled, substr('{"^" * ORDER}' || host || path, i, {ORDER + 1}) AS run FROM (SELECT *, unnest(range(1, length(host || path) + 1)) AS i FROM c)),
seen AS (SELECT run, count(*) FILTER (WHERE ruled = 'allow') AS na, count(*) FILTER (WHERE ruled = 'block') AS nb FROM runs GROUP BY run),
{", ".join(levels)},
scores AS (SELECT page_id, any_value(ruled) AS ruled, avg(ln(pa) - ln(pb)) AS score FROM runs JOIN m{ORDER} USING (run) GROUP BY page_id),
u AS (SELECT DISTINCT host, path, ruled, score FROM c JOIN scores USING (page_id, ruled)),
k AS (SELECT avg(score) FILTER (WHERE ruled = 'allow') AS ma, avg(score) FILTER (WHERE ruled = 'block') AS mb, coalesce(stddev_pop(score) FILTER (WHERE ruled = 'allow'), 0) + 1e-9 AS sa, coalesce(stddev_pop(score) FILTER (WHERE ruled = 'block'), 0) + 1e-9 AS sb FROM u),
t AS (SELECT (ma * sb + mb * sa) / (sa + sb) AS lim FROM k)
SELECT c.page_id, host, path, rule, coalesce(c.ruled, CASE WHEN score < lim THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN scores s ON c.page_id = s.page_id CROSS JOIN t
"""


OP9_SQL = _oracle()
