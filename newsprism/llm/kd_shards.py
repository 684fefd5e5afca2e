"""Sharding by a k-d tree over metadata, with DataFrame functions only.

A row's coordinates are its text size (logarithm), language, source and first
doc_id; names take a hashed place on the unit interval.  A node that still holds
several shards is split along its widest coordinate at the weighted median of the
bytes (in proportion to the shards on either side), until every leaf holds
one shard's bytes.  Medians are found over the whole table by histograms of at
most ``BINS`` bins a node: each round adds up bytes by bin, and the bin that
holds the median is the next round's range.  Only those rows (one a node) reach the driver.

Equal texts share one point (the least language, source and doc_id of the group),
so they share a shard unless their group is larger than ``WHOLE`` of all bytes; such a
group, of which there can only be 1 / ``WHOLE``, is dealt in slices by doc_id.
The law is ``bytes``: sizes are near equal.

Defined results: a null text has size 1 like an empty one; null metadata has its own
place; rows without doc_id are sharded like others; repeated rows get a slot each;
an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import write_and_reload
from ..sources.tables import table
from .registry import register

SHARDS, BINS, WHOLE, CLOSE = 16, 1024, 0.001, 0.0002
#: rows of one slot block (a shard's slots are counted block by block)
BLOCK = 1000
COORDINATES = ("c_size", "c_lang", "c_source", "c_age")
_TIE = 1 << 32


def _place(c: str) -> Column:
    """A hashed place in [0, 1) of a name, null apart."""
    return F.when(F.col(c).isNull(), F.lit(0.0)).otherwise(F.crc32(F.col(c).cast("string")) / F.lit(float(_TIE)))


def _pick(values: dict[int, object], default=None) -> Column:
    """The value of the row's node."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    found = F.element_at(F.create_map(*pairs), F.col("node"))
    return found if default is None else F.coalesce(found, F.lit(default))


def _position(coordinate: dict[int, int]) -> Column:
    """Order of a row along its node's coordinate: the place, then the tie hash."""
    place = F.element_at(F.array(*COORDINATES), _pick(coordinate))
    return F.floor(place * F.lit(float((1 << 30) - 1))).cast("long") * F.lit(_TIE) + F.col("tie")


def _points(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, coordinates, tie) of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = write_and_reload(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64("text").alias("text_key"),
        _place("lang").alias("c_lang"), _place("source").alias("c_source")), "sizes")
    groups = rows.groupBy("text_key", "size").agg(
        F.sum("size").alias("bytes"), F.min("c_lang").alias("c_lang"), F.min("c_source").alias("c_source"),
        F.min("doc_id").alias("first_id"))
    total, low, high, most = rows.agg(F.sum("size"), F.min("doc_id"), F.max("doc_id"), F.max("size")).first()
    slices = F.greatest(F.ceil(F.col("bytes") / F.lit(max(1.0, WHOLE * (total or 1)))), F.lit(1))
    groups = groups.withColumn("slices", slices)
    span = float(max(1, (high or 0) - (low or 0)))
    joined = rows.select("doc_id", "size", "text_crc32", "text_key").join(groups, ["text_key", "size"])
    cut = F.when(F.col("slices") > 1, F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("slices"))).otherwise(F.lit(0))
    return joined.select(
        "doc_id", "size", "text_crc32",
        (F.log2(F.col("size").cast("double")) / F.lit(max(1e-9, math.log2(max(2, most or 2))))).alias("c_size"),
        "c_lang", "c_source",
        F.coalesce((F.col("first_id") - F.lit(low or 0)) / F.lit(span), F.lit(0.0)).alias("c_age"),
        F.pmod(F.xxhash64("text_key", "size", cut), F.lit(_TIE)).alias("tie"))


def _cuts(atoms: DataFrame, nodes: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """(coordinate, last position of the left side) of each node that holds
    several shards, over (node, bytes, coordinates, tie)."""
    ranges = atoms.groupBy("node").agg(F.sum("bytes").alias("bytes"),
                                       *[(F.max(c) - F.min(c)).alias(c) for c in COORDINATES]).collect()
    ranges = {r.node: r for r in ranges if nodes.get(r.node, 1) > 1}
    coordinate = {n: 1 + max(range(len(COORDINATES)), key=lambda j: (r[COORDINATES[j]], -j)) for n, r in ranges.items()}
    need = {n: float(r.bytes) * (nodes[n] // 2) / nodes[n] for n, r in ranges.items()}
    lo, hi = {n: 0 for n in ranges}, {n: (1 << 62) - 1 for n in ranges}
    cut: dict[int, int] = {}
    order = Window.partitionBy("node").orderBy("bin")
    while len(cut) < len(ranges):
        open_ = [n for n in ranges if n not in cut]
        width = {n: -(-(hi[n] - lo[n] + 1) // BINS) for n in open_}
        at = atoms.where(F.col("node").isin(open_)).withColumn("at", _position({n: coordinate[n] for n in open_}))
        at = at.where(F.col("at").between(_pick({n: lo[n] for n in open_}), _pick({n: hi[n] for n in open_})))
        position = F.col("at") - _pick({n: lo[n] for n in open_})
        wide = _pick({n: width[n] for n in open_})
        bins = at.groupBy("node", ((position - F.pmod(position, wide)) / wide).cast("long").alias("bin")).agg(
            F.sum("bytes").alias("w"), F.min("at").alias("first"), F.max("at").alias("last"))
        up = bins.withColumn("up", F.sum("w").over(order))
        left = _pick({n: need[n] for n in open_})
        middle = up.where((F.col("up") >= left) & (F.col("up") - F.col("w") < left)).collect()
        for r in middle:
            n, below = r.node, r.up - r.w
            if r["first"] == r["last"] or r.w <= CLOSE * ranges[n].bytes:
                cut[n] = r["last"] if r.up - need[n] <= need[n] - below else r["first"] - 1
            else:
                lo[n], hi[n], need[n] = r["first"], r["last"], need[n] - below
        for n in set(open_) - {r.node for r in middle}:  # nothing to cut: all to the left
            cut[n] = hi[n]
    return coordinate, cut


def shards(docs: DataFrame, count: int = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of (doc_id, text, lang,
    source); ``target_bytes`` sets the number of shards from the total."""
    points = write_and_reload(_points(docs), "points")
    if target_bytes:
        count = max(1, -(-(points.agg(F.sum("size")).first()[0] or 1) // target_bytes))
    atoms = points.groupBy(*COORDINATES, "tie").agg(F.sum("size").alias("bytes")).withColumn("node", F.lit(1))
    rows, atoms = points.withColumn("node", F.lit(1)), write_and_reload(atoms, "atoms")
    nodes, first = {1: count}, {1: 0}
    while any(k > 1 for k in nodes.values()):
        coordinate, cut = _cuts(atoms, nodes)
        last = {n: cut.get(n, (1 << 62)) for n, k in nodes.items() if k > 1}
        along = {n: coordinate.get(n, 1) for n in last}
        right = F.when(F.col("node").isin(list(last)), (_position(along) > _pick(last)).cast("int")).otherwise(0)
        step = F.col("node") * 2 + right
        rows, atoms = rows.withColumn("node", step), atoms.withColumn("node", step)
        new, place = {}, {}
        for n, k in nodes.items():
            half = k // 2 if k > 1 else k
            new[2 * n], place[2 * n] = half, first[n]
            if k > 1:
                new[2 * n + 1], place[2 * n + 1] = k - half, first[n] + half
        nodes, first = new, place
        atoms = write_and_reload(atoms, "atoms")
    told = write_and_reload(rows.select("doc_id", "size", "text_crc32", "tie", _pick(first).alias("shard")), "told")
    blocks = max(1, told.count() // (count * BLOCK))
    told = told.withColumn("block", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(blocks)))
    before = told.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    nth = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size"))
    return (told.withColumn("nth", nth).join(before.select("shard", "block", F.coalesce("before", F.lit(0)).alias("before")),
                                             ["shard", "block"])
            .select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
                    (F.col("before") + F.col("nth") - 1).cast("long").alias("slot")))


@register("op4_kd_shards")
def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))
