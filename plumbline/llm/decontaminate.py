"""5. Benchmark decontamination: size-partitioned MinHash containment search, verified on whole shingle sets.

A short item in a long document has a tiny Jaccard similarity, so signatures of the two are no use. Here
the item's MinHash coordinates keep their arguments: the shingles with the least hashes. Each is a uniform
draw from the item, so the share of coordinates whose shingle a document contains estimates containment,
however long the document is (containment MinHash, Koslicki and Zabeti, 2019). Items are partitioned by
size; a partition has its number of coordinates and of hits that a candidate needs. Only DataFrame
functions are used; document shingles meet the coordinates of the benchmark, broadcast while these are few.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, table

WORDS = 5
PERCENT = 80
COORDINATES = 32
#: A pair at the threshold is no candidate with at most this probability.
MISS = 1e-9
#: Rows of the item side up to which it is broadcast (about 50 bytes each); beyond that both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def needed_hits(n: int, share: float, miss: float = MISS) -> int:
    """The most hits h of n with P(Binomial(n, share) < h) <= miss, at least 1."""
    below, h = 0.0, 0
    while h < n and below + comb(n, h) * share**h * (1 - share) ** (n - h) <= miss:
        below += comb(n, h) * share**h * (1 - share) ** (n - h)
        h += 1
    return max(h, 1)


def partition_rules(percent: int, coordinates: int = COORDINATES) -> list[tuple[int, int, int]]:
    """(size below which it holds, coordinates, hits): small items need fewer draws to name each shingle."""
    return [(limit, n, needed_hits(n, percent / 100)) for limit, n in ((5, coordinates // 2), (17, 3 * coordinates // 4))] + [(1 << 62, coordinates, needed_hits(coordinates, percent / 100))]


def shingles(text: Column, k: int = WORDS) -> Column:
    """Hashes of all k-word shingles, A-Z lower-cased; fewer words: of all words; none or null: empty."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    many = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(w[i + j] for j in range(k))))
    few = lambda w: F.array(F.xxhash64(F.lit("few"), F.concat_ws(" ", w)))
    # the words are bound once, to a lambda's variable
    return F.flatten(F.transform(F.array(parts), lambda w: F.when(F.size(w) >= k, many(w)).when(F.size(w) > 0, few(w)).otherwise(F.array().cast("array<bigint>"))))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id_col, item_col, n_item, n_common) for every item of which a document contains percent of the distinct shingles or more.

    Null, empty and blank texts contain nothing and are contained in nothing. Null ids take no part. Rows
    that share an id are one document (or item). Texts are read whole. No rows on a side: no rows out.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    sets = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.explode(shingles(F.col(item_text).cast("string"), k)).alias("h")).distinct()
    sets = sets.join(sets.groupBy("item").agg(F.count("*").alias("n_item")), "item")
    sets = scratch.put(sets, "items")
    rules = partition_rules(percent)
    pick = lambda i: F.coalesce(*(F.when(F.col("n_item") < r[0], F.lit(r[i])) for r in rules))
    drawn = sets.withColumn("j", F.explode(F.sequence(F.lit(1), pick(1))))
    drawn = drawn.groupBy("item", "n_item", "j").agg(F.min_by("h", F.struct(F.xxhash64("h", "j"), "h")).alias("h"))
    probes = scratch.put(drawn.groupBy("item", "n_item", "h").agg(F.count("*").alias("draws")).withColumn("hits", pick(2)), "probes")
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")

    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    met = source.select("id", F.explode(shingles(F.col("text"), k)).alias("h")).join(few(probes), "h").select("id", "item", "h", "draws", "hits").distinct()
    candidates = scratch.put(met.groupBy("id", "item").agg(F.sum("draws").alias("d"), F.first("hits").alias("hits")).where("d >= hits").select("id", "item"), "candidates")

    again = source.hint("merge").join(candidates.select("id").distinct(), "id", "left_semi")
    common = again.select("id", F.explode(shingles(F.col("text"), k)).alias("h")).join(few(sets), "h").select("id", "item", "n_item", "h").distinct()
    counted = common.groupBy("id", "item").agg(F.first("n_item").alias("n_item"), F.count("*").alias("n_common"))
    found = counted.join(candidates, ["id", "item"], "left_semi").where(F.col("n_common") * 100 >= F.col("n_item") * percent)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_item", "n_common")


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, unchanged, whose id contains no item."""
    bad = leaks(docs, items, id_col, text_col).select(F.col(id_col).alias("plumb_gone")).distinct()
    return docs.join(bad, docs[id_col] == F.col("plumb_gone"), "left_anti")


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


_SETS = r"""SELECT DISTINCT {id}, array_to_string(ws[i:i + 4], ' ') AS s FROM (
  SELECT {id}, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM (
    SELECT {id}, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM {t})
  WHERE len(ws) > 0)"""
OP5_SQL = f"""
WITH d AS ({_SETS.format(id="doc_id", t="documents")}), b AS ({_SETS.format(id="item_id", t="benchmark")}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_common FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= n_item * {PERCENT}
"""
