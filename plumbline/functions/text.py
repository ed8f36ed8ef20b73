"""Scalar text functions: Column to Column, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and classes whose results must agree with what users have today.
BLANKS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CHINESE, ACCENTED = r"[一-鿿]", r"[À-ÿ]"
BLANK_CHARS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # those of BLANKS
PUNCTUATION = "，。、；：？！（）【】《》“”‘’'\"()[]{}.,;:?!-—_/\\|+*#@&%"  # does not count when copies are compared
CONTENTS = r"\.{6,}|·{6,}|…{4,}|-{6,}"
HEADING = r"^\s*(#{1,6})\s+(.+)"
SUFFIXES = {"pdf": "pdf", "md": "md", "txt": "md", "html": "html", "htm": "html", "docx": "docx"}
ORDINAL = r"^第?([一二两三四五1-5])[个条款]?$"
ORDINALS = {"一": 1, "两": 2, "二": 2, "三": 3, "四": 4, "五": 5, "1": 1, "2": 2, "3": 3, "4": 4, "5": 5}
INTENT_LEGS = {"chitchat": [], "meta": ["web"], "troubleshoot": ["vector", "kg"], "product_qa": ["vector", "hyde", "kg", "web"], "compare": ["vector", "hyde", "kg", "web"]}


def table_of(spark, sf_dir: str, name: str, *columns: str):
    """The named columns of a Parquet table (all, if none is named)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(rows, *by: str):
    """rows dealt anew over the session's shuffle partitions, for work that is far more than the bytes of a small file show."""
    return rows.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def without_blanks(text: Column) -> Column:
    """No blanks at all. Single characters are taken out several times faster than by a pattern."""
    return F.translate(text, BLANK_CHARS, "")


def squeezed(text: Column) -> Column:
    """Runs of blanks become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, BLANKS + "+", " "))


def stripped(text: Column) -> Column:
    """No blanks at the ends."""
    return F.regexp_replace(text, f"^{BLANKS}+|{BLANKS}+$", "")


def script_ratio(text: Column, script: str = CHINESE) -> Column:
    """Share of a script's characters among those that are not blank; 0 for none."""
    solid = F.length(without_blanks(text))
    return F.when(solid > 0, F.regexp_count(text, F.lit(script)) / solid).otherwise(F.lit(0.0))


def is_contents(text: Column) -> Column:
    return text.rlike(CONTENTS)


#: Blanks and PUNCTUATION as one class of a pattern.
UNCOMPARED = BLANKS[:-1] + "".join(f"\\{c}" if c.isascii() else c for c in PUNCTUATION) + "]"


def compared_form(text: Column, digits: bool = False) -> Column:
    """A text without blanks, PUNCTUATION and (unless asked for) decimal digits, for comparing copies."""
    if digits:
        return F.translate(text, BLANK_CHARS + PUNCTUATION, "")
    return F.regexp_replace(F.translate(text, BLANK_CHARS + PUNCTUATION + "0123456789", ""), r"\p{Nd}", "")


def char_shingles(text: Column, n: int = 8) -> Column:
    """Distinct runs of n characters; a shorter text is its own; empty: none."""

    def of(t: Column) -> Column:
        runs = F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))  # one pass, not a search for every place
        return F.when(F.length(t) >= n, F.array_distinct(runs)).when(F.length(t) > 0, F.array(t)).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.array(text), of))  # text is computed once, and bound


def least_of(items: Column, k: int = 24) -> Column:
    return F.slice(F.array_sort(items), 1, k)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def item_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, BLANKS, ""))


def title_key(title: Column) -> Column:
    return F.lower(F.regexp_replace(F.replace(title, F.lit("##"), F.lit("")), BLANKS, ""))


def option_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[\s\x{A0}\x{3000}_-]", ""))


def ordinal(key: Column) -> Column:
    """The place (from 1) that a reply such as 第2个 names; null for other replies."""
    places = F.create_map(*(F.lit(x) for pair in ORDINALS.items() for x in pair))
    return F.element_at(places, F.nullif(F.regexp_extract(key, ORDINAL, 1), F.lit("")))


def chosen(key: Column, keys: Column) -> Column:
    """The place (from 1) of the option that a reply means, both as option keys; null for none.

    An ordinal names it if there are so many options; otherwise it is the first that holds the reply or is
    held by it. Empty replies and options fit nothing.
    """
    fits = F.transform(keys, lambda k: (key != "") & (k != "") & (F.contains(k, key) | F.contains(key, k)))
    place = F.nullif(F.array_position(fits, True), F.lit(0)).cast("int")
    return F.when(ordinal(key) <= F.size(keys), ordinal(key)).otherwise(place)


def without_item(question: Column, item: Column) -> Column:
    """The question without the item's name, in any case and with any blanks between its characters; blanks squeezed."""
    pattern = F.regexp_replace(F.replace(item, F.lit(" "), F.lit("")), "(?s)(.)", r"\\Q$1\\E\\s*")
    bare = F.when(pattern != "", F.regexp_replace(question, F.concat(F.lit("(?i)"), F.regexp_replace(pattern, r"\\s\*$", "")), F.lit(""))).otherwise(question)
    return squeezed(bare)


def extracted_items(reply: Column, question: Column) -> tuple[Column, Column]:
    """(item names, rewritten question) of a model's JSON reply, which may be fenced.

    Names are the strings that are not blank of a list, any other value gives none; a rewritten question that
    is no string or blank, and a reply that is no JSON, leave the question as it was.
    """
    parsed = F.try_parse_json(without_fence(reply))
    listed = F.coalesce(F.try_variant_get(parsed, "$.item_names", "array<variant>"), F.array().cast("array<variant>"))
    strings = F.filter(listed, lambda v: F.schema_of_variant(v) == "STRING")
    names = F.filter(F.transform(strings, lambda v: F.variant_get(v, "$", "string")), lambda s: stripped(s) != "")
    rewritten = F.try_variant_get(parsed, "$.rewritten_query", "variant")
    told = F.when(F.schema_of_variant(rewritten) == "STRING", stripped(F.variant_get(rewritten, "$", "string")))
    return names, F.when(F.length(told) > 0, told).otherwise(question)


def without_fence(text: Column) -> Column:
    """The inside of a fenced block, or the text itself."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def hard_split_rate(text: Column, lines_a_heading: int = 25) -> Column:
    """How far headings are missing: 1 without any, 0 if there is one for every so many lines."""
    lines = F.split(text, "\n")
    headings = F.size(F.filter(lines, lambda x: x.rlike(HEADING)))
    wanted = F.greatest(F.lit(1.0), F.size(lines) / F.lit(float(lines_a_heading)))
    rate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - headings / wanted))
    return F.when(F.length(text) == 0, F.lit(0.0)).when(headings == 0, F.lit(1.0)).otherwise(rate)


def blob_sha1(content: Column) -> Column:
    """The id that version control gives a file of this content."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "utf-8"), F.unhex(F.lit("00")), content.cast("binary")))


def fetched_fault(content: Column, wanted: Column, least: int = 50_000, signature: str = "%PDF") -> Column:
    """What is wrong with a fetched file (binary), the first of: size, signature, blob; null if nothing is. A null wanted blob id is not compared."""
    starts = F.substring(content, 1, len(signature)) == F.lit(signature).cast("binary")
    return F.when(content.isNull() | (F.octet_length(content) < least), "size").when(~starts, "signature").when(wanted != blob_sha1(content), "blob")


def route(path: Column) -> Column:
    """The reader for a file by its suffix; null for others."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.element_at(F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair)), suffix)


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x.cast("double"), digits)
