"""Conflict-constrained best-fit packing of texts into fixed-size bins.

A text takes its words plus one end mark.  Longer texts are cut into pieces
of the whole capacity, each a bin of its own, and a rest.  Rests go, largest
first, to the tightest bin that fits and does not conflict: bins are kept in
the order of their residual space and carry bitmaps of the duplicate clusters
and sources inside them; the search starts at the first bin with enough room and goes on to
its successors until a compatible one is found, else a new bin is opened.
A bin holds at most one text of a cluster and ``PER_SOURCE`` of a source (that many
bitmap planes).

Rows are dealt by hash into packing groups of about ``GROUP_ROWS`` rows, so a hot
source or cluster is spread over all groups and a group has a bounded size;
each group is packed alone and loses at most its last bins' space.

Defined results: null, empty and blank texts take one place and belong to no cluster;
a null source conflicts with nothing; equal rows are packed each, in different bins; ties
go by doc_id, then cluster; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .groups import whole_groups
from .registry import register

CAPACITY, PER_SOURCE, GROUP_ROWS = 4096, 4, 4096
SCHEMA = ("doc_id bigint, source string, cluster bigint, piece bigint, size bigint, bin_id bigint, bin_offset bigint, "
          "bin_used bigint")


def best_fit(sizes: list[int], clusters: list, sources: list, capacity: int, per_source: int) -> list[int]:
    """The bin of each item, items taken in the given order.  A cluster or
    source of None conflicts with nothing."""
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    bit = {c: 1 << k for k, c in enumerate(c for c, n in seen.items() if n > 1 and c is not None)}
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    order: list[tuple[int, int]] = []
    in_cluster: list[int] = []
    planes: list[list[int]] = []
    out = []
    for size, cluster, source in zip(sizes, clusters, sources):
        c, s = bit.get(cluster, 0), source_bit.get(source, 0)
        at = bisect_left(order, (size, -1))
        while at < len(order) and (in_cluster[order[at][1]] & c or planes[order[at][1]][-1] & s):
            at += 1
        if at < len(order):
            room, b = order.pop(at)
        else:
            room, b = capacity, len(planes)
            in_cluster.append(0)
            planes.append([0] * per_source)
        in_cluster[b] |= c
        for k in range(per_source):
            if not planes[b][k] & s:
                planes[b][k] |= s
                break
        if room > size:
            insort(order, (room - size, b))
        out.append(b)
    return out


def _pack_group(rows: pa.Table, capacity: int, per_source: int):
    group = rows.column("pack_group")[0].as_py()
    docs, sources, clusters = (rows.column(c).to_pylist() for c in ("doc_id", "source", "cluster"))
    sizes = rows.column("size").to_pylist()
    rest = [n % capacity for n in sizes]
    order = sorted((i for i, n in enumerate(rest) if n), key=lambda i: (-rest[i], docs[i] is None, docs[i] or 0, clusters[i] or 0,
                                                                        sources[i] or ""))
    bins = best_fit([rest[i] for i in order], [clusters[i] for i in order], [sources[i] for i in order], capacity, per_source)
    used = [0] * (max(bins, default=-1) + 1)
    out = []
    for i, b in zip(order, bins):
        out.append([i, sizes[i] // capacity, rest[i], b, used[b]])
        used[b] += rest[i]
    for i, n in enumerate(sizes):
        for piece in range(n // capacity):
            out.append([i, piece, capacity, len(used), 0])
            used.append(capacity)
    at, piece, size, b, offset = (np.array(x, dtype=np.int64) for x in zip(*out))
    take = pa.array(at)
    return [rows.column("doc_id").take(take), rows.column("source").take(take), rows.column("cluster").take(take),
            pa.array(piece), pa.array(size), pa.array((group << 32) + b), pa.array(offset), pa.array(np.array(used)[b])]


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, cluster: Column | None = None,
         group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece of (doc_id, text, source): doc_id, source, cluster, piece,
    size, bin_id, bin_offset (where the piece starts) and bin_used (of its bin).
    ``cluster`` names the duplicate cluster (default: equal texts)."""
    if capacity < 1 or per_source < 1:
        raise ValueError("capacity and per_source must be positive")
    groups = max(1, -(-docs.count() // group_rows))
    words = n_words()
    cluster = F.xxhash64("text") if cluster is None else cluster
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                         F.when(words > 0, cluster).alias("cluster"), (words + 1).alias("size"))
    dealt = narrow.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "cluster", "source"), F.lit(groups)))

    def run(batches):
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for part in whole_groups(batches, "pack_group"):
            key = part.column("pack_group").to_numpy()
            edges = np.append(np.flatnonzero(np.diff(key, prepend=key[0] - 1)), len(key))
            for a, b in zip(edges, edges[1:]):
                columns = _pack_group(part.slice(a, b - a), capacity, per_source)
                yield from pa.Table.from_arrays(columns, names=names).combine_chunks().to_batches()

    return dealt.repartition("pack_group").sortWithinPartitions("pack_group").mapInArrow(run, SCHEMA)


@register("op9_bestfit")
def op9_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
