"""1. MinHash near-dedup: circulant MinHash, banding, and exact Jaccard on full sets.

C-MinHash needs two permutations: sigma scatters a set once, and pi, shifted circularly by k = 1, 2, ...,
gives coordinate k as the least pi(sigma(x) + k). Here both are bijections of 32-bit integers.

Plan: (a) one Python pass makes each document's set fingerprint and band hashes; (b) documents with equal
sets become one class, by a map-side minimum; (c) in each band bucket every member is compared with two
hubs, on full sets; (d) members of a group of buckets that are still apart are compared in blocks, by
signature and then on full sets: all of a group, or, of one with very many apart (made by chains), those that
share a bucket; (e) components. No step lists the pairs of a group: a block gives at most one link for two components. Joins that carry texts or bands are sort-merge joins at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, table
from .vecbytes import LOWER, Hasher, U, blocks, lists, mix, raw, words

#: At similarity 0.8 a pair shares no band with probability (1 - 0.8^6)^42 = 3e-6.
ROWS, BANDS = 6, 42
K = ROWS * BANDS
#: At similarity 0.8 fewer equal coordinates than this come with probability 1e-6 (binomial, 252 draws).
AGREE_AT = 4.75
#: Documents of a group that are compared at once: those still apart, and all.
PROBES, MEMBERS = 256, 1024
#: Members still apart up to which a group is compared as one; beyond, each bucket of it is, as that copies a member BANDS times at most.
WHOLE = PROBES * BANDS
#: A hub is tried first on members that meet it in so many buckets (at 0.8 a pair meets in 11 of 42); step (d) takes the rest.
MEETINGS = 3
_SHIFT = np.arange(1, K + 1, dtype=np.uint32)[:, None]
_A, _B, _S = np.uint32(0x7FEB352D), np.uint32(0x846CA68B), np.uint32(15)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles, A-Z lower-cased; fewer words: of all of them; none: empty."""
    data, offsets = raw(column)
    data = LOWER[data]
    starts, ends, row = words(data, offsets)
    h = Hasher(data)(starts, ends)
    at = np.searchsorted(row, np.arange(len(offsets)))
    rolled = h.copy()
    for j in range(1, k):
        rolled[: len(h) - j] = mix(rolled[: len(h) - j] * U(0x9E3779B97F4A7C15) + h[j:]) if len(h) > j else 0
    out = []
    for i in range(len(offsets) - 1):
        a, b = at[i], at[i + 1]
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            one = h[a]
            for j in range(a + 1, b):
                one = mix(one * U(0x9E3779B97F4A7C15) + h[j : j + 1])[0]
            out.append(mix(np.array([one ^ U(b - a)])))
        else:
            out.append(h[:0])
    return out


def signature(x: np.ndarray) -> np.ndarray:
    """The K circulant coordinates of a set of hashes."""
    z = (x >> U(32)).astype(np.uint32)  # sigma: the hash is already scattered
    out = np.full(K, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(z), 256):
        m = _SHIFT + z[None, i : i + 256]
        m *= _A
        m ^= m >> _S
        m *= _B
        np.minimum(out, m.min(1), out=out)
    return out


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    part = signatures.reshape(len(signatures), BANDS, ROWS).astype(U)
    h = np.broadcast_to(np.arange(BANDS, dtype=U), part.shape[:2])
    for j in range(ROWS):
        h = mix(h * U(0x9E3779B97F4A7C15) + part[:, :, j])
    return h


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                sets = shingle_sets(block.column(1), k)
                n = np.array([len(s) for s in sets])
                full = [s for s in sets if len(s)]
                bands = band_hashes(np.array([signature(s) for s in full], np.uint32).reshape(-1, K)).ravel()
                sums = [np.array([f(s) if len(s) else 0 for s in sets], dtype=U) for f in (lambda s: mix(s).sum(dtype=U), lambda s: np.bitwise_xor.reduce(s))]
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), pa.array(n), *(pa.array(s.view(np.int64)) for s in sums), lists(pa.array(bands.view(np.int64)), (n > 0) * BANDS)],
                    names=["id", "n", "f1", "f2", "bands"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                sets = shingle_sets(block.column(1), k)
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([signature(s).astype(np.uint8).tobytes() for s in sets], pa.binary())], names=["id", "items", "sig"])

    return run


def _verify(percent: int):
    """Rows sorted by hub and salt, the hub's own row first: links that hold on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, U)
        for batch in batches:
            a, b = [], []
            for h, first, doc, items in zip(*(batch.column(x).to_pylist() for x in ("hub", "first", "doc")), batch.column("items"), strict=True):
                x = np.frombuffer(items.as_buffer(), U)
                if first:
                    hub, own = h, x
                elif h == hub and len(x) and len(own):
                    both = int((own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x).sum())
                    if 100 * both >= percent * (len(x) + len(own) - both):
                        a.append(h), b.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _across(percent: int):
    """Rows sorted by group and blocks, the probes first: links on full sets that join components, one for each two at most."""
    s = percent / 100
    least = K * s - AGREE_AT * (K * s * (1 - s)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, probes, sigs, over = None, [], None, {}

        def top(part: int) -> int:
            while (up := over.get(part, part)) != part:
                part = up
            return part

        for batch in batches:
            a, b = [], []
            columns = (batch.column(x).to_pylist() for x in ("kind", "group", "block", "slice", "probe", "doc", "part"))
            for *at, probe, doc, part, sig, items in zip(*columns, batch.column("sig"), batch.column("items"), strict=True):
                if at != key:
                    key, probes, sigs, over = at, [], None, {}
                x, own = np.frombuffer(sig.as_buffer(), np.uint8), np.frombuffer(items.as_buffer(), U)
                if probe:
                    probes.append((doc, part, x, own))
                    continue
                if sigs is None:
                    sigs = np.array([p[2] for p in probes])
                for i in np.flatnonzero((sigs == x).sum(1) >= least):
                    other, its_part, _, its = probes[i]
                    if top(part) != top(its_part):
                        both = int((own[np.minimum(np.searchsorted(own, its), len(own) - 1)] == its).sum())
                        if 100 * both >= percent * (len(own) + len(its) - both):
                            over[top(part)] = top(its_part)
                            a.append(max(doc, other)), b.append(min(doc, other))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a: hub, b) that hold on full sets. A hub's set goes to one task for each 64 or so of its members."""
    pairs = pairs.distinct()
    salted = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("c")), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / 64)).alias("salt"))
    sets = sets.select("id", "items")
    member = salted.join(sets, salted.b == sets.id).select(F.col("a").alias("hub"), "salt", F.lit(False).alias("first"), F.col("b").alias("doc"), "items")
    hubs = salted.select("a", "salt").distinct()
    hub = hubs.join(sets, hubs.a == sets.id).select(F.col("a").alias("hub"), "salt", F.lit(True).alias("first"), F.col("a").alias("doc"), "items")
    rows = member.unionByName(hub).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.desc("first"))
    return rows.mapInArrow(_verify(percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, whole: int = WHOLE) -> DataFrame:
    """Per row of docs: id_col, n_shingles, component_id (smallest id reachable by links of Jaccard >= percent/100), kept.

    Null, empty and blank texts have an empty set, link with nothing and stay. A null id links with nothing
    and stays (component_id null). Rows that repeat an id are one document: they stay or go together.
    Texts of any length are read whole. No rows in: no rows out. Other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = scratch.put(source.mapInArrow(_fingerprints(k), "id long, n long, f1 long, f2 long, bands array<long>"), "prints")
    usable = prints.where("n > 0 and id is not null")
    classes = usable.groupBy("f1", "f2").agg(F.min(F.struct("id", "n", "bands")).alias("r"), F.count("*").alias("copies"))
    classes = scratch.put(classes.select("f1", "f2", "copies", "r.id", "r.n", "r.bands"), "classes")

    members = classes.select(F.explode("bands").alias("bucket"), "id")
    hubs = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("size > 1").drop("size")
    met = members.hint("merge").join(hubs, "bucket").groupBy("id", "lo", "hi").agg(F.count("*").alias("c"))
    met = scratch.put(met, "met")
    facts = [met.where(F.col(h) != F.col("id")).groupBy(F.col(h).alias("a"), F.col("id").alias("b")).agg(F.sum("c").alias("c")) for h in ("lo", "hi")]
    stars = facts[0].unionByName(facts[1]).where(F.col("c") >= MEETINGS).select("a", "b")

    wanted = met.select("id").distinct()
    sets = scratch.put(source.hint("merge").join(wanted, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_sets(k), "id long, items binary, sig binary"), "sets")
    links = scratch.put(_confirmed(stars, sets, percent), "links")
    first = components(links, scratch, "first")

    groups = components(met.select(F.col("id").alias("a"), F.col("lo").alias("b")), scratch, "group")
    groups = groups.select(F.col("node").alias("id"), F.col("component").alias("group"))
    groups = groups.unionByName(groups.select(F.col("group").alias("id"), "group").distinct())
    placed = groups.join(first, groups.id == first.node, "left").select("group", "id", F.coalesce("component", "id").alias("part"))
    counted = placed.groupBy("group", "part").agg(F.count("*").alias("c"))
    apart = counted.groupBy("group").agg(F.sum("c").alias("m"), F.max(F.struct("c", "part")).alias("top")).where("m > top.c")
    parts = lambda n, of: F.ceil(n / of).cast("long")
    facing_of = lambda df, by: df.select(by, F.col("top.part").alias("top"), parts(F.col("m") - F.col("top.c"), PROBES).alias("blocks"), parts(F.col("m"), MEMBERS).alias("slices"))
    apart = scratch.put(apart, "apart")
    # a group that chains have made large is taken apart again: its members are compared in each bucket, of equal buckets in one
    large = placed.join(apart.where(F.col("m") - F.col("top.c") > whole).select("group"), "group", "left_semi").select("id", "part")
    crowd = scratch.put(members.hint("merge").join(large, "id"), "crowd")
    per_part = crowd.groupBy("bucket", "part").agg(F.count("*").alias("c"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64("id")).alias("x"))
    mixed = per_part.groupBy("bucket").agg(F.sum("c").alias("m"), F.max(F.struct("c", "part")).alias("top"), F.sum("h").alias("h"), F.bit_xor("x").alias("x")).where("m > top.c")
    mixed = facing_of(mixed.groupBy("m", "h", "x").agg(F.min(F.struct("bucket", "top")).alias("b")).select("m", "b.bucket", "b.top"), "bucket")
    in_buckets = crowd.join(mixed, "bucket").withColumn("group", F.col("bucket")).drop("bucket").withColumn("kind", F.lit(1))
    in_groups = placed.join(facing_of(apart.where(F.col("m") - F.col("top.c") <= whole), "group"), "group").withColumn("kind", F.lit(0))
    open_ = in_groups.unionByName(in_buckets).join(sets, "id")
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    probe = open_.where("part <> top").withColumn("block", place("blocks")).withColumn("slice", numbers("slices")).withColumn("probe", F.lit(True))
    other = open_.withColumn("slice", place("slices")).withColumn("block", numbers("blocks")).withColumn("probe", F.lit(False))
    shape = ["kind", "group", "block", "slice", "probe", F.col("id").alias("doc"), "part", "sig", "items"]
    keys = ["kind", "group", "block", "slice"]
    facing = probe.select(*shape).unionByName(other.select(*shape)).repartition(*keys).sortWithinPartitions(*keys, F.desc("probe"))
    found = components(links.unionByName(facing.mapInArrow(_across(percent), "a long, b long")), scratch, "final")

    multiple = classes.where("copies > 1").select("f1", "f2", F.col("id").alias("rep"))
    known = prints.select("id", "n", "f1", "f2").join(multiple, ["f1", "f2"], "left").withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "id")).otherwise(F.col("id")))
    out = known.join(found, known.rep == found.node, "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, unchanged, that near_duplicates keeps: one document of each component."""
    gone = near_duplicates(docs, id_col, text_col, k, percent).where("not kept").select(F.col(id_col).alias("plumb_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == F.col("plumb_gone"), "left_anti")


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), k=2)
