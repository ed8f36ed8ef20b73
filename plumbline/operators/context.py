"""Prompt context under a budget of characters, history windows, and session decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped
from . import prefix

# Budgets and limits in effect, and what a model code looks like.
BUDGET, HISTORY, CLARIFY_TURNS = 12_000, 10, 2
PICKED, PICKED_CHARS, LEAST_CHARS = 3, 2500, 10
PREFIX_CHARS, SAMPLE_CHARS, QUOTES = 150, 800, '"“”「」'
MODEL_CODE = r"[A-Za-z]{1,}[\- ]?\d{2,}[A-Za-z0-9\-]*"


def within_budget(rows: DataFrame, key: str, order: str, cost: Column, budget: Column, spread: bool = False) -> DataFrame:
    """Rows of each key up to the first that would pass the budget; later, shorter rows are not considered. used: what they cost together.

    spread: keys may have very many rows, so their sums are taken in ranges and no task holds a key.
    """
    if spread:
        return prefix.running(rows, key, order, used=cost).where(F.col("used") <= budget)
    running = F.sum(cost).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", running).where(F.col("used") <= budget)


def recent(messages: DataFrame, key: str, order: str, n: int = HISTORY) -> DataFrame:
    """The last n messages of each key, numbered from the oldest of them."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    last = messages.withColumn("plumb_back", back).where(F.col("plumb_back") <= n).drop("plumb_back")
    return last.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def item_context(chunks: DataFrame, key: str, order: str, k: int = PICKED, most: int = PICKED_CHARS) -> DataFrame:
    """(key, sample): the k most telling of the first chunks (key, order, title, file_title, lang, content), for a model to find the item in.

    Looked at are the first 3k (15 at least) of a document, less those of under 10 characters. A model code counts 2,
    a title that is not the file's 1, a language other than mixed 1, and each place later 0.1 less. Those picked come
    in their order, each after its number, up to the one that passes most characters, and are clipped there. If none
    is long enough, the first k chunks that are not blank are taken. Titles and contents are trimmed, nulls are empty.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    pool = max(3 * k, 15)
    trimmed = lambda c: stripped(F.coalesce(c, F.lit("")))
    rows = chunks.select(key, order, F.col("content"), "title", "file_title", "lang").withColumn("i", place).where(F.col("i") <= pool)
    rows = rows.select(key, "i", trimmed(F.col("content")).alias("content"), trimmed(F.col("title")).alias("title"), "file_title", "lang")
    titled = (F.col("title") != "") & ~F.col("title").eqNullSafe(F.col("file_title"))
    score = 2 * F.col("content").rlike(MODEL_CODE).cast("int") + titled.cast("int") + (~F.col("lang").eqNullSafe(F.lit("mixed"))).cast("int")
    tenths = 10 * score - (F.col("i") - 1)  # whole numbers, so that equal scores are equal
    long = F.length("content") >= LEAST_CHARS
    usable = F.max(long.cast("int")).over(Window.partitionBy(key)) == 1
    rows = rows.withColumns({"plumb_rank": tenths, "plumb_use": F.when(usable, long).otherwise((F.col("i") <= k) & (F.col("content") != ""))}).where("plumb_use")
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.when(F.length("content") >= LEAST_CHARS, F.col("plumb_rank")).otherwise(0)), "i"))
    # more than most characters of a piece are never seen
    piece = F.concat(F.lit("[切片]-"), F.col("i").cast("string"), F.lit("-"), F.substring("content", 1, most + 1))
    picked = rows.withColumn("plumb_n", best).where(F.col("plumb_n") <= k).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", piece.alias("piece")))), lambda x: x["piece"]).alias("pieces"))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"))

    def step(done: Column, x: Column) -> Column:
        added = F.struct(F.concat(done["text"], F.when(done["used"] > 0, F.lit("\n\n")).otherwise(F.lit("")), x).alias("text"), (done["used"] + F.length(x)).alias("used"))
        return F.when(done["used"] > most, done).otherwise(added)

    return picked.select(key, F.substring(F.aggregate("pieces", start, step)["text"], 1, most).alias("sample"))


def context_prefix(said: Column, most: int = PREFIX_CHARS) -> Column:
    """A model's sentence as a chunk's prefix: no blanks, then no quotes at its ends, clipped."""
    return F.substring(F.trim(stripped(F.coalesce(said, F.lit(""))), F.lit(QUOTES)), 1, most)


def content_sample(content: Column, most: int = SAMPLE_CHARS) -> Column:
    """What of a chunk a model is shown."""
    return F.substring(content, 1, most)


def citation(place: Column, **fields: Column) -> Column:
    """[place] and [name=value] for every field that is not null."""
    parts = [F.concat(F.lit("["), place.cast("string"), F.lit("]"))]
    parts += [F.concat(F.lit(f"[{name}="), value.cast("string"), F.lit("]")) for name, value in fields.items()]
    return F.concat_ws(" ", *parts)


def clarify(confirmed: Column, options: Column, turn: Column, most: int = CLARIFY_TURNS) -> Column:
    """What a session does next: search, ask, ask again, or go on without an item."""
    return F.when(confirmed > 0, "search").when((options > 0) & (turn == 0), "ask").when((options > 0) & (turn < most), "ask_again").otherwise("degrade")


def buckets(matches: DataFrame, high: float = 0.7, mid: float = 0.6, most: int = 3) -> DataFrame:
    """(name, confirmed, options) from (name, item, score): one match of high score or the equal name is confirmed.

    Several high ones without the equal name are options, else those of mid score; at most so many, best first, ties by item.
    """
    order = Window.partitionBy("name").orderBy(F.desc("score"), "item")
    rows = matches.withColumn("n", F.row_number().over(order)).withColumn("equal", (F.col("name") == F.col("item")) & (F.col("score") >= high))
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("n", "item")))), lambda x: x["item"])
    top = (F.col("score") >= high) & (F.col("n") <= most)
    second = (F.col("score") >= mid) & (F.col("n") <= most)
    each = rows.groupBy("name").agg(F.count_if(F.col("score") >= high).alias("highs"), F.max("equal").alias("equal"), F.min_by("item", "n").alias("best"), pick(top).alias("tops"), pick(second).alias("seconds"))
    confirmed = F.when(F.col("equal"), F.col("name")).when(F.col("highs") == 1, F.col("best"))
    options = F.when(confirmed.isNotNull(), F.array().cast("array<string>")).when(F.col("highs") > 1, F.col("tops")).otherwise(F.col("seconds"))
    return each.select("name", confirmed.alias("confirmed"), F.array_join(options, "|").alias("options"))


def within_gap(scores: DataFrame, key: str, gap: float = 0.15) -> DataFrame:
    """Rows whose score lies within gap of the key's best."""
    return scores.withColumn("plumb_best", F.max("score").over(Window.partitionBy(key))).where(F.round(F.col("plumb_best") - F.col("score"), 9) <= gap).drop("plumb_best")
