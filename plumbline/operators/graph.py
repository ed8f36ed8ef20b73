"""A property graph in two DataFrames: nodes (item, name, ...) and edges (item, head, kind, tail)."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..sources.scratch import Scratch

# Names and numbers of the graph rules.
MENTION, DEFAULT_KIND = "MENTIONED_IN", "RELATED_TO"
SEED_WEIGHT, NEIGHBOUR_WEIGHT = 2.0, 1.0
NAME_CHARS = 15
PER_PAIR, PER_QUERY, TRIPLES = 3, 30, 50
#: Rows that are broadcast, counted: the sizes of files say little of what rows take in the driver's memory.
BROADCAST_ROWS = 250_000


def bounded(rows: DataFrame) -> DataFrame:
    """rows for one side of a join: broadcast if they are few, else never."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.hint("merge")


def entity_name(name: Column) -> Column:
    return F.substring(stripped(name), 1, NAME_CHARS)


def merged_entities(mentions: DataFrame) -> DataFrame:
    """(item, name, source_chunk_id, description, labels) from (item, name, ord, chunk_id, description, label).

    The first chunk stays, the last description that is not empty wins, labels add up (sorted). All three are
    partial aggregates, so a very common entity costs one row a task.
    """
    told = F.when(F.length(F.coalesce("description", F.lit(""))) > 0, F.struct("ord", "description"))
    return mentions.groupBy("item", "name").agg(F.min(F.struct("ord", "chunk_id"))["chunk_id"].alias("source_chunk_id"), F.max(told)["description"].alias("description"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


def clean_entities(entities: DataFrame, labels: list[str], scope: str = "chunk_id") -> DataFrame:
    """(scope, name, label, description) from (scope, ord, name, label, description): named entities of the labels, each once a scope.

    The first by ord stays, with its description or null (of equal ord null, then the least). A partial minimum, so repeats of a common entity cost one row a task.
    """
    rows = entities.select(scope, "ord", entity_name(F.col("name")).alias("name"), stripped(F.col("label")).alias("label"), F.nullif(stripped(F.col("description")), F.lit("")).alias("description"))
    first = rows.where((F.col("name") != "") & F.col("label").isin(*labels)).groupBy(scope, "name", "label").agg(F.min(F.struct("ord", "description")).alias("first"))
    return first.select(scope, "name", "label", "first.description")


def clean_seeds(rows: DataFrame) -> DataFrame:
    """Rows whose item and name are not blank, both trimmed; nulls are blank."""
    return rows.withColumns({c: stripped(F.col(c)) for c in ("item", "name")}).where("item <> '' and name <> ''")


def cleared(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Nodes or edges without those of the items (a column item)."""
    return rows.join(items.select("item").distinct(), "item", "left_anti")


def clean_relations(relations: DataFrame, nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """Distinct relations with both ends among the nodes of their item; unknown kinds become the default."""
    kind = F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise(DEFAULT_KIND)
    named = relations.select("item", entity_name(F.col("head")).alias("head"), kind.alias("kind"), entity_name(F.col("tail")).alias("tail")).where("head <> '' and tail <> ''")
    for end in ("head", "tail"):
        named = named.join(nodes.select("item", F.col("name").alias(end)), ["item", end], "left_semi")
    return named.select("item", "head", "kind", "tail").distinct()


@dataclass(frozen=True)
class Built:
    """Counts of a build: chunks, those that were read well and those that failed, and what the former gave."""

    total: int
    processed: int
    failed: int
    entities: int
    relations: int

    def summary(self) -> str:
        return f"{self.processed} of {self.total} chunks, {self.failed} failed, {self.entities} entities, {self.relations} relations"


def built(extracted: DataFrame) -> tuple[DataFrame, Built]:
    """extracted (chunk_id, entities array, relations array, error) written once, and its counts, taken in the pass that writes.

    A chunk with an error gives no entities or relations; null arrays are empty.
    """
    good = F.col("error").isNull()
    size = lambda c: F.coalesce(F.sum(F.when(good, F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)))), F.lit(0))
    told = Observation()
    counted = extracted.observe(told, F.count("*").alias("total"), F.count_if(good).alias("processed"), F.count_if(~good).alias("failed"), size("entities").alias("entities"), size("relations").alias("relations"))
    rows = Scratch(extracted.sparkSession, "build").put(counted, "chunks")
    return rows.where("error is null"), Built(**told.get)


@dataclass(frozen=True)
class Store:
    """Edges written once, clustered so that a join from a node needs no shuffle of edges.

    out, back: relations (item, head, kind, tail) by (item, head) and by (item, tail); mentions: (item, name,
    chunk_id) by (item, name), or none; names: distinct (item, name) of mentions.
    """

    out: DataFrame
    back: DataFrame
    mentions: DataFrame | None
    names: DataFrame


def stored(edges: DataFrame, buckets: int | None = None) -> Store:
    """edges (item, head, kind, tail) as bucketed tables in the shared folder; their number is that of shuffle partitions."""
    all_ = Scratch(edges.sparkSession, "graph").put(edges.select("item", "head", "kind", "tail").distinct(), "edges", by="kind")
    mentions = all_.where(F.col("kind") == MENTION).select("item", F.col("head").alias("name"), F.col("tail").alias("chunk_id"))
    return _store(all_.where(F.col("kind") != MENTION), mentions, None, buckets)


def related(relations: DataFrame, names: DataFrame, buckets: int | None = None) -> Store:
    """A store without mentions, for what needs relations (item, head, kind, tail) and names (item, name) only; both may repeat."""
    held = Scratch(relations.sparkSession, "graph").put(relations.select("item", "head", "kind", "tail").distinct(), "relations")
    return _store(held, None, names, buckets)


def _store(relations: DataFrame, mentions: DataFrame | None, names: DataFrame | None, buckets: int | None) -> Store:
    spark = relations.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    scratch, label = Scratch(spark, "graph"), uuid.uuid4().hex

    def clustered(df: DataFrame, name: str, *by: str) -> DataFrame:
        table = f"plumb_{name}_{label}"
        df.repartition(n, *by).write.bucketBy(n, *by).sortBy(*by).option("path", f"{scratch.root}/{name}").saveAsTable(table)
        return spark.table(table)

    relations = relations.select("item", "head", "kind", "tail")
    by_name = None if mentions is None else clustered(mentions, "mentions", "item", "name")
    names = by_name if names is None else names
    return Store(clustered(relations, "out", "item", "head"), clustered(relations, "back", "item", "tail"), by_name, scratch.put(names.select("item", "name").distinct(), "names"))


def once(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asked (query_id, item, asked) of one question for each set of pairs, and (query_id, first) of all: equal questions are answered once."""
    pairs = asked.select("query_id", "item", "asked").distinct()
    sets = pairs.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("item", "asked"))).alias("pairs"))
    firsts = sets.groupBy("pairs").agg(F.min("query_id").alias("first"))
    return firsts.select(F.col("first").alias("query_id"), F.inline("pairs")), sets.join(firsts, "pairs").select("query_id", "first")


def for_all(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows of the questions that were answered, for every question that equals one."""
    return rows.withColumnRenamed("query_id", "first").join(members, "first").select("query_id", *(c for c in rows.columns if c != "query_id"))


def _grams(text: Column, n: int) -> Column:
    """Distinct runs of n characters; none for shorter texts."""
    places = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


#: Length of the grams by which names meet; shorter names and questions meet by themselves.
GRAM = 3


def near_pairs(asked: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, item, asked, name, fits: pairs of one item that may contain each other, and whether they do, in any case.

    A name that contains what is asked holds its rarest gram among the item's names; what is asked contains a name
    only if it holds the name's rarest gram. So pairs meet by one gram, not all names of an item with all questions.
    Empty names and questions meet nothing. No side with a row for every gram is broadcast: what is known of its size
    is that of the names.
    """
    low, short = F.lower("name"), F.least(F.length("name"), F.lit(GRAM))
    known = names.select("item", "name").distinct().where("name <> ''")
    index = known.select("item", "name", F.explode(F.concat(*(_grams(low, n) for n in range(1, GRAM + 1)))).alias("gram"))
    often = index.groupBy("item", "gram").agg(F.count("*").alias("names")).hint("merge")
    pairs = asked.select("query_id", "item", "asked").distinct().where("asked <> ''").withColumn("low", F.lower("asked"))
    own = F.concat(*(F.when(F.least(F.length("low"), F.lit(GRAM)) == n, _grams(F.col("low"), n)).otherwise(F.array().cast("array<string>")) for n in range(1, GRAM + 1)))
    # one gram that no name has, and no name contains the question
    wanted = pairs.select("item", "asked", own.alias("grams")).distinct().select("item", "asked", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(often, ["item", "gram"])
    rare = wanted.groupBy("item", "asked", "n").agg(F.count("*").alias("found"), F.min(F.struct("names", "gram")).alias("least")).where("found = n")
    holding = rare.select("item", "asked", F.col("least.gram").alias("gram")).join(index.hint("merge"), ["item", "gram"]).select("item", "asked", "name")
    # the other way round: names by their rarest gram, questions by all of theirs
    signed = index.where(F.length("gram") == short).join(often, ["item", "gram"]).groupBy("item", "name").agg(F.min(F.struct("names", "gram")).alias("least"))
    all_grams = F.concat(*(_grams(F.col("low"), n) for n in range(1, GRAM + 1)))
    spread = pairs.select("item", "asked", all_grams.alias("grams")).distinct().select("item", "asked", F.explode("grams").alias("gram"))
    held = spread.join(signed.select("item", "name", F.col("least.gram").alias("gram")).hint("merge"), ["item", "gram"]).select("item", "asked", "name")
    met = holding.unionByName(held).distinct()
    fits = F.contains(F.lower("name"), F.lower("asked")) | F.contains(F.lower("asked"), F.lower("name"))
    return pairs.select("query_id", "item", "asked").join(met, ["item", "asked"]).select("query_id", "item", "asked", "name", fits.alias("fits"))


def seeds(asked: DataFrame, nodes: DataFrame, exact: int = 1, fuzzy: int = PER_PAIR, total: int = PER_QUERY) -> DataFrame:
    """(query_id, item, asked, name, how): the node of that name, or else up to so many of the item whose name contains it or is contained.

    Fuzzy pairs meet by rare grams (see near_pairs), and only for names that no node has; ties go by name. A
    question has at most total seeds, in order of item, asked and name.
    """
    pairs = asked.select("query_id", "item", "asked").distinct()
    known = nodes.select("item", "name").distinct()
    same = pairs.join(known.withColumn("asked", F.col("name")).hint("merge"), ["item", "asked"]).select("query_id", "item", "asked", "name").withColumn("how", F.lit("exact"))
    open_ = pairs.join(same, ["query_id", "item", "asked"], "left_anti")
    near = near_pairs(open_, known).where("fits").drop("fits").withColumn("how", F.lit("fuzzy"))
    n = F.row_number().over(Window.partitionBy("query_id", "item", "asked").orderBy("name"))
    some = same.unionByName(near).withColumn("n", n).where(F.col("n") <= F.when(F.col("how") == "exact", exact).otherwise(fuzzy))
    return _first(some, total, "query_id", "item", "asked", "name").drop("n")


def _first(rows: DataFrame, k: int, of: str, *order: str) -> DataFrame:
    return rows.withColumn("plumb_n", F.row_number().over(Window.partitionBy(of).orderBy(*order))).where(F.col("plumb_n") <= k).drop("plumb_n")


def one_hop(seed_rows: DataFrame, edges: DataFrame | Store, per_seed: int = TRIPLES, total: int = TRIPLES) -> DataFrame:
    """(query_id, item, seed, head, kind, tail, other): relations of a seed in both directions, mentions left out.

    A triple counts once a question, for the first of its seeds; a question has at most total triples, in order
    of item, seed, head, kind and tail.
    """
    s = seed_rows.select("query_id", "item", F.col("name").alias("seed")).distinct()
    e, f = (edges.out, edges.back) if isinstance(edges, Store) else (edges.where(F.col("kind") != MENTION),) * 2
    shape = ["query_id", "item", "seed", "head", "kind", "tail", "other"]
    # the seed's own columns are the join keys, so that edges clustered by them stay where they are
    out = s.join(e, (s["item"] == e["item"]) & (s["seed"] == e["head"])).select("query_id", s["item"], "seed", "head", "kind", "tail", F.col("tail").alias("other"))
    back = s.join(f, (s["item"] == f["item"]) & (s["seed"] == f["tail"])).select("query_id", s["item"], "seed", "head", "kind", "tail", F.col("head").alias("other")).select(*shape)
    n = F.row_number().over(Window.partitionBy("query_id", "item", "seed").orderBy("head", "kind", "tail"))
    near = out.unionByName(back).distinct().withColumn("n", n).where(F.col("n") <= per_seed)
    once = near.groupBy("query_id", "item", "head", "kind", "tail").agg(F.min(F.struct("seed", "other")).alias("s"))
    return _first(once.select("query_id", "item", "s.seed", "head", "kind", "tail", "s.other"), total, "query_id", "item", "seed", "head", "kind", "tail")


def node_weights(seed_rows: DataFrame, hops: DataFrame) -> DataFrame:
    """(query_id, item, name, weight): seeds 2, neighbours 1, the larger wins; nothing for a question without any relation."""
    asked = hops.select("query_id").distinct()
    s = seed_rows.join(asked, "query_id", "left_semi").select("query_id", "item", "name", F.lit(SEED_WEIGHT).alias("weight"))
    n = hops.select("query_id", "item", F.col("other").alias("name"), F.lit(NEIGHBOUR_WEIGHT).alias("weight"))
    return s.unionByName(n).groupBy("query_id", "item", "name").agg(F.max("weight").alias("weight"))


def chunk_evidence(weights: DataFrame, edges: DataFrame | Store, top: int = 50) -> DataFrame:
    """(query_id, chunk_id, score, entities, rank): chunks that mention weighted nodes; order by score, entities, chunk id, all descending."""
    m = edges.mentions if isinstance(edges, Store) else edges.where(F.col("kind") == MENTION).select("item", F.col("head").alias("name"), F.col("tail").alias("chunk_id"))
    return mention_evidence(weights, m, top)


def mention_evidence(weights: DataFrame, mentions: DataFrame, top: int = 50) -> DataFrame:
    """The same of mentions (item, name, chunk_id), which may repeat.

    Chunks of an item that mention the same weighted nodes score alike for a question about this item only, so they
    are one class, of which the top largest ids are kept; and a question needs no more than the top classes, as each
    has a chunk. Questions about several items, whose chunks add up, meet mentions one by one.
    """
    scratch = Scratch(weights.sparkSession, "evidence")
    items = weights.groupBy("query_id").agg((F.min("item") == F.max("item")).alias("plumb_one"))
    weights = scratch.put(weights.join(items, "query_id"), "weights")
    nodes = scratch.put(weights.where("plumb_one").select("item", "name").distinct().withColumn("code", F.monotonically_increasing_id()), "nodes")
    told = mentions.join(bounded(nodes), ["item", "name"]).groupBy("item", "chunk_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    nth = F.row_number().over(Window.partitionBy("item", "codes").orderBy(F.desc("chunk_id")))
    kept = scratch.put(told.withColumn("nth", nth).where(F.col("nth") <= top), "kept")
    classes = scratch.put(kept.where("nth = 1").select("item", "codes", F.col("chunk_id").alias("last"), F.monotonically_increasing_id().alias("class")), "classes")
    coded = weights.where("plumb_one").join(nodes, ["item", "name"]).select("query_id", "code", "weight")
    scored = classes.select("class", "last", F.explode("codes").alias("code")).hint("merge").join(coded, "code").groupBy("query_id", "class", "last").agg(F.sum("weight").alias("score"), F.count("*").alias("entities"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("entities"), F.desc("last")))
    scored = scored.withColumn("plumb_best", best).where(F.col("plumb_best") <= top).join(classes.select("class", "item", "codes").hint("merge"), "class")
    each = scored.join(kept, ["item", "codes"]).select("query_id", "chunk_id", "score", "entities")
    several = weights.where("not plumb_one")
    if not several.isEmpty():
        met = several.join(mentions.select("item", "name", "chunk_id").distinct(), ["item", "name"])
        each = each.unionByName(met.groupBy("query_id", "chunk_id").agg(F.sum("weight").alias("score"), F.count("*").alias("entities")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("entities"), F.desc("chunk_id")))
    return each.withColumn("rank", rank).where(F.col("rank") <= top)


def triple_text(item: Column, head: Column, kind: Column, tail: Column) -> Column:
    return F.format_string("[%s] %s -(%s)-> %s", item, head, kind, tail)
