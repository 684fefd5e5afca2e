"""Near duplicates by a chosen-path set similarity join.

A text is the set of its distinct 5-word shingles.  Texts with equal sets are
one member from the start.  Independent trees branch the members by selected
minwise tokens: a node picks coordinates of the minwise signature, one
over the similarity threshold of them on average, and a member goes on to one
child for each picked coordinate, named by its token there.  Nodes of at most
``LEAF`` members are compared exhaustively on signatures; larger ones branch
again.  Trees are repeated until the target recall of a pair at the threshold
is met for nodes as deep as ``LEVELS``.

The comparisons of the leaves give families: texts connected by estimates
that may be links.  All links lie inside families, and a family's full sets,
each text's once, are brought together to find its groups exactly.  A family
of more than ``FAMILY_BYTES`` of sets is not brought together: its leaves are
compared on the full sets instead, one leaf a time.

Large nodes of near copies hardly shrink by branching.  Members nearly equal
to the node's first member leave it along a link to that member (confirmed on full
sets later) when no member lies at a middle distance: by the triangle inequality nothing else can
then link to them alone.  What is still large after ``LEVELS`` levels is
compared in blocks, so no task ever holds more than two blocks.

Defined results: null, empty and blank texts have no shingles and stay alone;
a text with fewer than five words is one shingle; each row belongs to the group
of its own text, and of rows that share a doc_id the pipeline stage drops all
if it drops one; rows without doc_id take no part and stay; an empty table
gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_and_reload
from ..sources.tables import table
from . import textflat
from .groups import bounded_batches, connected, whole_groups
from .registry import register

WORDS = 5
SIMILARITY = (75, 100)
COORDINATES = 128
LEAF, LEVELS, RECALL = 4096, 6, 0.999
#: full sets of a family that one task may hold
FAMILY_BYTES = 32 << 20
#: a pair at the threshold falls short of MAYBE by four standard errors of the estimate
MAYBE = 0.60
#: estimates of members that may leave a large node, and of those that forbid it
NEAR, MIDDLE = 0.92, 0.50
_SALT = np.uint64(0xD6E8FEB86659FD93)
_A = (np.random.default_rng(11).integers(0, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))
_B = np.random.default_rng(12).integers(0, 1 << 32, COORDINATES, dtype=np.uint32)


def trees_for(recall: float = RECALL, levels: int = LEVELS, similarity: float = SIMILARITY[0] / SIMILARITY[1]) -> int:
    """Trees needed so that a pair at the threshold shares a node of depth ``levels``."""
    one, two = 2 - 1 / similarity, 1 / similarity - 1  # share of nodes that pick one and two coordinates
    miss = 0.0
    for _ in range(levels):
        each = 1 - similarity + similarity * miss
        miss = one * each + two * each * each
    return math.ceil(math.log(1 - recall) / math.log(miss))


def _picks(node: np.ndarray) -> np.ndarray:
    """Two coordinates per node; the second is -1 where the node picks one."""
    r = textflat.mix64(node ^ _SALT)
    lam = SIMILARITY[0] / SIMILARITY[1]
    first = (r % np.uint64(COORDINATES)).astype(np.int64)
    second = ((r >> np.uint64(8)) % np.uint64(COORDINATES - 1)).astype(np.int64)
    second += second >= first
    two = ((r >> np.uint64(40)).astype(np.float64) / float(1 << 24)) < (1 / lam - 1)
    return np.stack([first, np.where(two, second, -1)], axis=1)


def _child(node: np.ndarray, coordinate: np.ndarray, token: np.ndarray) -> np.ndarray:
    return textflat.mix64(textflat.mix64(node + textflat._C1 * (coordinate.astype(np.uint64) + np.uint64(1)))
                          + token.astype(np.uint64))


def shingle_sets(col: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, off = textflat.flat(col)
    starts, ends, doc_words = textflat.words(data, off)
    h = textflat.hash_spans(textflat.padded(textflat.lower_ascii(data)), starts, ends)
    win, at = textflat.window_hashes(h, doc_words, WORDS)
    cut = np.searchsorted(at, doc_words)
    out = []
    for k in range(len(off) - 1):
        n = doc_words[k + 1] - doc_words[k]
        if n >= WORDS:
            out.append(np.unique(win[cut[k]:cut[k + 1]]))
        elif n:
            g = np.full(1, n, np.uint64)
            for x in h[doc_words[k]:doc_words[k + 1]]:
                g = textflat.mix64(g * textflat._C1 + x)
            out.append(g)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each coordinate's hash over a (non-empty) set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 1024):
        low = np.minimum(low, (x[lo:lo + 1024, None] * _A[None, :] + _B[None, :]).min(axis=0))
    return low


def _roots(trees: int) -> tuple[np.ndarray, np.ndarray]:
    node = textflat.mix64(np.arange(1, trees + 1, dtype=np.uint64) * textflat._C3)
    picks = _picks(node)
    node, picks = np.repeat(node, 2), picks.ravel()
    return node[picks >= 0], picks[picks >= 0]


def signatures(docs: DataFrame, trees: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, sig, nodes) of every row with a doc_id;
    set_a and set_b name the set, sig has one byte per coordinate, nodes are
    the first-level nodes of all trees."""
    root, coordinate = _roots(trees)

    def run(batches):
        for batch in batches:
            for piece in textflat.pieces(batch, "text"):
                sets = shingle_sets(piece.column(1))
                a = [int((textflat.mix64(s).sum(dtype=np.uint64) if len(s) else np.uint64(0)).view(np.int64)) for s in sets]
                b = [int((textflat.mix64(s ^ _SALT).sum(dtype=np.uint64) if len(s) else np.uint64(0)).view(np.int64))
                     for s in sets]
                sig, nodes = [], []
                for s in sets:
                    if len(s):
                        low = minwise(s)
                        nodes.append(_child(root, coordinate, low[coordinate]).view(np.int64))
                        sig.append(((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes())
                    else:
                        nodes.append(np.zeros(0, np.int64))
                        sig.append(b"")
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(a, pa.int64()),
                     pa.array(b, pa.int64()), pa.array(sig, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "sig", "nodes"])

    return (docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, sig binary, nodes array<bigint>"))


def _matrix(col) -> np.ndarray:
    data, off = textflat.flat(col)
    return data.reshape(len(off) - 1, COORDINATES)


def _children(rows: DataFrame) -> DataFrame:
    """The next level's (node, doc, sig)."""
    def run(batches):
        for batch in batches:
            sig = _matrix(batch.column(2))
            node = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            picks = _picks(node)
            for c in (0, 1):
                k = np.flatnonzero(picks[:, c] >= 0)
                if len(k):
                    child = _child(node[k], picks[k, c], sig[k, picks[k, c]])
                    take = pa.array(k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(child.view(np.int64)), batch.column(1).take(take), batch.column(2).take(take)],
                        names=["node", "doc", "sig"])

    return rows.select("node", "doc", "sig").mapInArrow(run, "node bigint, doc bigint, sig binary")


def _against_first(rows: DataFrame) -> DataFrame:
    """(node, doc, sig, first, estimate): similarity to the node's first member."""
    first = rows.groupBy("node").agg(F.min(F.struct("doc", "sig")).alias("f"))

    def run(batches):
        for batch in batches:
            same = (_matrix(batch.column(2)) == _matrix(batch.column(4))).mean(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(same, pa.float64())],
                                             names=["node", "doc", "sig", "first", "estimate"])

    return (rows.join(first, "node").select("node", "doc", "sig", F.col("f.doc").alias("first"), F.col("f.sig").alias("s"))
            .mapInArrow(run, "node bigint, doc bigint, sig binary, first bigint, estimate double"))


def _search(n: int, reach):
    """Breadth-first search over items 0..n-1, where ``reach(i, rest)`` tells which
    of ``rest`` item i links to: yields (least item of the component, other
    item).  An item is compared with the items not yet reached only."""
    rest = np.arange(n)
    while len(rest) > 1:
        start = rest[0]
        queue, rest = [start], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = reach(i, rest)
            if hit.any():
                for j in rest[hit].tolist():
                    yield start, j
                    queue.append(j)
                rest = rest[~hit]


def _leaf_edges(doc: np.ndarray, sig: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """(least member, member) of what estimates that may be links connect in one leaf."""
    order = np.argsort(doc, kind="stable")
    doc, sig, side = doc[order], sig[order], side[order]
    across = side.any()

    def reach(i, rest):
        ok = (sig[rest] == sig[i]).mean(axis=1) >= MAYBE
        return ok & (side[rest] != side[i]) if across else ok

    return [(doc[i], doc[j]) for i, j in _search(len(doc), reach)]


def _maybe_edges(rows: DataFrame) -> DataFrame:
    """Distinct (a, b) that connect what may be linked, over leaves (node, doc, sig, side)."""
    def run(batches):
        for part in whole_groups(batches, "node"):
            node = part.column("node").to_numpy()
            doc, sig, side = part.column("doc").to_numpy(), _matrix(part.column("sig")), part.column("side").to_numpy()
            lo = np.flatnonzero(np.diff(node, prepend=node[0] ^ 1))
            hi = np.append(lo[1:], len(node))
            two = lo[hi - lo == 2]
            two = two[(sig[two] == sig[two + 1]).mean(axis=1) >= MAYBE]
            edges = [e for x, y in zip(lo[hi - lo > 2], hi[hi - lo > 2]) for e in _leaf_edges(doc[x:y], sig[x:y], side[x:y])]
            a = np.concatenate([doc[two], np.array([e[0] for e in edges], np.int64)])
            b = np.concatenate([doc[two + 1], np.array([e[1] for e in edges], np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    sorted_ = rows.select("node", "doc", "sig", "side").repartition("node").sortWithinPartitions("node")
    return sorted_.mapInArrow(run, "a bigint, b bigint").where("a <> b").distinct()


def exact_edges(sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(least index, index) of what the similarity threshold connects."""
    num, den = SIMILARITY
    size = np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    off = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(flat) + 1, bool)
    state = {"rest": None}

    def reach(i, rest):
        if state["rest"] is None or len(state["rest"]) != len(rest) or state["rest"][0] != rest[0]:
            lengths = size[rest]
            start = np.cumsum(lengths) - lengths
            state["flat"] = flat[np.repeat(off[rest] - start, lengths) + np.arange(lengths.sum())]
            state["start"], state["rest"] = start, rest
        own = flat[off[i]:off[i + 1]]
        mark[own] = True
        same = np.add.reduceat(mark[state["flat"]], state["start"], dtype=np.int64)
        mark[own] = False
        ok = den * same >= num * (size[i] + size[rest] - same)
        return ok & (side[rest] != side[i]) if side is not None and side.any() else ok

    return list(_search(len(sets), reach))


def _exact(rows: DataFrame, key: str) -> DataFrame:
    """(a, b): edges that connect linked texts inside the groups ``key`` of
    (key, doc, side, shingles), on full sets."""
    def run(batches):
        for part in whole_groups(batches, key):
            name, doc, side = (part.column(c).to_numpy() for c in (key, "doc", "side"))
            data, off = textflat.flat(part.column("shingles"))
            order = np.lexsort((doc, name))
            name = name[order]
            edges = np.append(np.flatnonzero(np.diff(name, prepend=name[0] ^ 1)), len(name))
            a, b = [], []
            for x, y in zip(edges, edges[1:]):
                at = order[x:y]
                sets = [np.frombuffer(data[off[i]:off[i + 1]], np.uint64) for i in at]
                for i, j in exact_edges(sets, side[at]):
                    a.append(doc[at[i]])
                    b.append(doc[at[j]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    sorted_ = rows.select(key, "doc", "side", "shingles").repartition(key).sortWithinPartitions(key)
    return sorted_.mapInArrow(run, "a bigint, b bigint").where("a <> b")


def _blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Large nodes dealt into pairs of blocks of about LEAF / 2 members: leaves
    (node, doc, sig, side), where side tells two different blocks apart."""
    n = F.ceil(F.col("size") / F.lit(LEAF // 2)).cast("int")
    mine = F.pmod(F.xxhash64("doc", F.lit(7)), F.col("n")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    return (rows.join(sizes, "node").withColumn("n", n).withColumn("mine", mine).select("*", other.alias("other"))
            .select(F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("node"), "doc", "sig",
                    F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side")))


def leaves(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All leaves (node, doc, sig, side) of all trees over (doc, sig, nodes),
    and the links (a, b) along which near-equal members left large nodes."""
    keys = members.select("doc", F.explode("nodes").alias("node"))
    sizes = keys.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = write_and_reload(keys.join(sizes, "node").join(members.select("doc", "sig"), "doc")
                            .select("node", "doc", "sig", "size"), "nodes")
    done = [rows.where(F.col("size") <= LEAF).select("node", "doc", "sig", F.lit(0).alias("side"))]
    links = None
    rows = rows.where(F.col("size") > LEAF)
    for level in range(2, LEVELS + 1):
        if rows.isEmpty():
            return _union(done), links
        seen = write_and_reload(_against_first(rows), "hot_nodes")
        middle = seen.groupBy("node").agg(
            F.max(F.when((F.col("estimate") >= MIDDLE) & (F.col("estimate") < NEAR), 1).otherwise(0)).alias("middle"))
        told = seen.join(middle, "node")
        leaves_node = (F.col("middle") == 0) & (F.col("estimate") >= NEAR) & (F.col("doc") != F.col("first"))
        out = told.where(leaves_node).select(F.col("first").alias("a"), F.col("doc").alias("b"))
        links = out if links is None else links.unionByName(out)
        below = write_and_reload(_children(told.where(~leaves_node)), "branches")
        sizes = below.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        rows = write_and_reload(below.join(sizes, "node"), "nodes")
        done.append(rows.where(F.col("size") <= LEAF).select("node", "doc", "sig", F.lit(0).alias("side")))
        rows = rows.where(F.col("size") > LEAF)
    if not rows.isEmpty():
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
        done.append(_blocks(rows.drop("size"), sizes))
    return _union(done), links


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    def check(batches):
        for batch in batches:
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in (2, 3))
            keep = [bool(exact_edges([p, q])) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return (pairs.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb")), "b")
            .select("a", "b", "sa", "sb").mapInArrow(check, "a bigint, b bigint"))


def _full_sets(docs: DataFrame, families: DataFrame) -> DataFrame:
    """(doc, family, large, shingles) of the texts in (doc, family, large)."""
    def sets(batches):
        for batch in batches:
            for piece in textflat.pieces(batch, "text"):
                found = pa.array([s.tobytes() for s in shingle_sets(piece.column(3))], pa.binary())
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], found], names=["doc", "family", "large", "shingles"])

    # a merge join at every size: the families grow with the input
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(families.hint("merge"), "doc")
    return write_and_reload(texts.select("doc", "family", "large", "text")
                            .mapInArrow(sets, "doc bigint, family bigint, large boolean, shingles binary")
                            .where("octet_length(shingles) > 0"), "shingles")


def _groups(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, component) of the members that link to another one."""
    rows, links = leaves(members)
    rows = write_and_reload(rows, "leaves")
    maybe = _maybe_edges(rows)
    families = connected(maybe if links is None else maybe.unionByName(links), "families")
    families = families.withColumnsRenamed({"node": "doc", "component": "family"})
    weights = (families.join(members.groupBy("doc").agg(F.sum("n_shingles").alias("n")), "doc")
               .groupBy("family").agg((8 * F.sum("n") > FAMILY_BYTES).alias("large")))
    sets = _full_sets(docs, write_and_reload(families.join(weights, "family").select("doc", "family", "large"), "families"))
    edges = _exact(sets.where(~F.col("large")).withColumn("side", F.lit(0)), "family")
    large = sets.where("large")
    if large.isEmpty():  # a family is searched whole: its edges lead to the least text of the group
        return write_and_reload(edges.groupBy(F.col("b").alias("doc")).agg(F.min("a").alias("component")), "groups")
    inside = rows.select("node", "doc", "side").join(large.select("doc", "shingles"), "doc")
    edges = edges.unionByName(_exact(inside, "node"))
    if links is not None:
        edges = edges.unionByName(_linked(links.distinct(), large))
    return connected(edges, "groups").withColumnRenamed("node", "doc")


def classes(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row that has a doc_id."""
    bounded_batches(docs.sparkSession)
    base = write_and_reload(signatures(docs, trees_for(recall)), "signatures")
    members = write_and_reload(
        base.where("n_shingles > 0").groupBy("n_shingles", "set_a", "set_b")
        .agg(F.min(F.struct("doc_id", "sig", "nodes")).alias("m"))
        .select("n_shingles", "set_a", "set_b", F.col("m.doc_id").alias("doc"), "m.sig", "m.nodes"), "members")
    found = _groups(members, docs)
    known = base.join(members.select("n_shingles", "set_a", "set_b", "doc"), ["n_shingles", "set_a", "set_b"], "left")
    return (known.withColumn("doc", F.coalesce("doc", "doc_id")).join(found, "doc", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc").alias("component_id")))


def removed_ids(named: DataFrame) -> DataFrame:
    return named.where("component_id <> doc_id").select("doc_id").distinct()


def one_of_each(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each group the row with the least doc_id stays."""
    gone = write_and_reload(removed_ids(classes(docs)), "removed")
    # a merge join at every size: what is removed grows with the input
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


@register("op2_path_join")
def op2_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return named.withColumn("kept", F.col("doc_id") == F.col("component_id"))
