"""The trie of conversation prefixes, with subtree sums by the Euler-tour technique.

A node is a distinct sequence of the first turns of conversations.  Turns are dealt into ranges by (conversation, order), so that a conversation of any
length spreads over tasks, and a rolling fingerprint runs along each range; as fingerprints compose, what a range begins with follows from
one row a range.  Grouped by fingerprint, conversations give nodes.  A node's name is (smallest member, depth): at one depth a conversation is
in one node.

Every node has an enter and an exit arc.  Enter leads to the first child's enter, or to the own exit; exit leads to the next
sibling's enter, or to the parent's exit; together they are one list, the Euler tour.  It is ranked in two steps.  Nodes are dealt into ranges by name,
in which a conversation's own nodes, and mostly those around it, are together; each task ranks the pieces of the list that it holds, and a piece becomes one
link of a shorter list.  That list is ranked by pointer jumping, in as many rounds as the logarithm of its length.  Sums of a subtree are then differences
of sums along the list, taken at the node's two arcs.

Hot keys: a first turn that a third of all conversations share is one row after an aggregate that combines before its shuffle; its
children meet it by salt, and find their next sibling in ranges by (parent, name).  The ids of conversations that end at one node are joined to
texts of ``IDS_A_TEXT`` ids in ranges before they meet, and hashed as they stream by, never held.

Fingerprints are polynomials in the turns' SHA-256 digests modulo 2^127 - 1; two sequences are one node by chance with a probability of depth / 2^127 for each pair.

Defined cases: turns are ordered by turn, null first, and then by digest; a null role or text is empty; repeated rows are turns of their own; rows without
conv_id take no part; a conversation without turns (given by id) is a member of the root; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, salt, salts_for, settled

#: Rows of a range, about: turns, or nodes of the tour.  One task holds a range of nodes.
TURNS_A_RANGE, NODES_A_RANGE, IDS_A_TEXT = 1 << 17, 1 << 15, 4096
MODULUS = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"prefix").digest()[:15], "big")
ROOT = bytes(16)


def _ranges(n: int, rows: int) -> int:
    return max(1, math.ceil(n / rows))


def turn_digest() -> Column:
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)


def chained(turns: DataFrame, *, carry: tuple[str, ...] = (), range_rows: int = TURNS_A_RANGE) -> DataFrame:
    """(conv_id, depth, node, parent, n_chars) and the columns of ``carry``: of each turn its place from 1, and the fingerprints with and without it."""
    told = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest().alias("digest"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), *carry,
    )
    kept = ", ".join(f"{c} {told.schema[c].dataType.simpleString()}" for c in ("n_chars", *carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, h = None, 0, 0
        for batch in batches:
            depth, node, parent = np.empty(len(batch), np.int64), [], []
            for k, (c, d) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("digest").to_pylist(), strict=True)):
                if c != own:
                    own, n, h = c, 0, 0
                parent.append(h.to_bytes(16, "big"))
                n, h = n + 1, (h * BASE + int.from_bytes(d, "big") + 1) % MODULUS
                depth[k] = n
                node.append(h.to_bytes(16, "big"))
            yield _with(batch, depth, node, parent)

    def _with(batch: pa.RecordBatch, depth: np.ndarray, node: list[bytes], parent: list[bytes]) -> pa.RecordBatch:
        made = [pa.array(depth), pa.array(node, pa.binary()), pa.array(parent, pa.binary())]
        names = ["conv_id", "range", "n_chars", *carry]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, "depth", "node", "parent"])

    order = ("conv_id", F.asc_nulls_first("turn"), "digest")
    dealt = told.repartitionByRange(_ranges(turns.count(), range_rows), *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    schema = f"conv_id long, range int, {kept}, depth long, node binary, parent binary"
    inside = checkpointed(dealt.mapInArrow(run, schema))

    # One row a range: what the conversation that goes on in the next range has so far.
    ends = inside.groupBy("range").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "depth", "node")).alias("last")).orderBy("range").collect()
    before: dict[int, tuple[int, int, int]] = {}
    open_ = None
    for r in ends:
        n, h = r["last"]["depth"], int.from_bytes(r["last"]["node"], "big")
        if open_ and open_[0] == r["first"]:
            before[r["range"]] = open_
            if r["last"]["conv_id"] == r["first"]:
                n, h = open_[1] + n, (open_[2] * pow(BASE, n, MODULUS) + h) % MODULUS
        open_ = (r["last"]["conv_id"], n, h)

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ranges = batch.column("conv_id").to_numpy(), batch.column("range").to_numpy()
            later = [k for k in range(len(batch)) if before.get(int(ranges[k]), (None,))[0] == ids[k]]
            if later:
                depth, node, parent = (batch.column(c) for c in ("depth", "node", "parent"))
                depth, node, parent = depth.to_numpy().copy(), node.to_pylist(), parent.to_pylist()
                for k in later:
                    _, n, h = before[int(ranges[k])]
                    ahead = h * pow(BASE, int(depth[k]) - 1, MODULUS)
                    parent[k] = ((ahead + int.from_bytes(parent[k], "big")) % MODULUS).to_bytes(16, "big")
                    node[k] = ((ahead * BASE + int.from_bytes(node[k], "big")) % MODULUS).to_bytes(16, "big")
                    depth[k] += n
                batch = _with(batch, depth, node, parent)
            yield batch

    return (inside.mapInArrow(go_on, schema) if before else inside).drop("range")


def ends_hashed(ends: DataFrame, *, ids_a_text: int = IDS_A_TEXT) -> DataFrame:
    """(node, ends_sha256): the hash of a node's conv_ids, ascending and joined by commas, of (node, conv_id)."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids = None, []
        for batch in batches:
            made: list[tuple[bytes, int, str]] = []
            for node, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (node != own or len(ids) == ids_a_text):
                    made.append((own, ids[0], ",".join(map(str, ids))))
                    ids = []
                own = node
                ids.append(c)
            yield rows(made)
        yield rows([(own, ids[0], ",".join(map(str, ids)))] if ids else [])

    def rows(made: list) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], names=["node", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = None, None
        for batch in batches:
            made = []
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if node == own:
                    sha.update(b",")
                else:
                    if sha:
                        made.append((own, sha.hexdigest()))
                    own, sha = node, hashlib.sha256()
                sha.update(ids.encode())
            yield told(made)
        yield told([(own, sha.hexdigest())] if sha else [])

    def told(made: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.string())], names=["node", "ends_sha256"])

    sorted_ = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").select("node", "conv_id")
    short = sorted_.mapInArrow(texts, "node binary, first long, ids string")
    return short.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node binary, ends_sha256 string")


def _next_siblings(nodes: DataFrame, n: int, range_rows: int) -> DataFrame:
    """``nodes`` with ``sibling``: the next child, by name, of the same parent."""
    dealt = checkpointed(nodes.repartitionByRange(_ranges(n, range_rows), "parent", "conv_id").withColumn("range", F.spark_partition_id()))
    bounds = dealt.groupBy("range").agg(F.min(F.struct("parent", "conv_id")).alias("first"), F.max(F.struct("parent", "conv_id")).alias("last"))
    bounds = bounds.orderBy("range").collect()  # one row a range
    across = [
        (a["last"]["parent"], a["last"]["conv_id"], b["first"]["conv_id"])
        for a, b in zip(bounds, bounds[1:], strict=False)
        if a["last"]["parent"] is not None and a["last"]["parent"] == b["first"]["parent"]
    ]
    inside = F.lead("conv_id").over(W.partitionBy("range", "parent").orderBy("conv_id"))
    told = dealt.withColumn("inside", F.when(F.col("parent").isNotNull(), inside)).drop("range")
    if not across:
        return told.withColumnRenamed("inside", "sibling")
    across = F.broadcast(nodes.sparkSession.createDataFrame(across, "parent binary, conv_id long, across long"))
    return told.join(across, ["parent", "conv_id"], "left").withColumn("sibling", F.coalesce("inside", "across")).drop("inside", "across")


#: What is summed along the tour: arcs, leaves, saved code points.
SUMS = ("arcs", "leaves", "saved")


def local_ranks(conv: np.ndarray, depth: np.ndarray, to: dict[str, tuple[np.ndarray, np.ndarray]], weights: np.ndarray):
    """The pieces of the tour among some nodes, in the order of (conv, depth).

    ``to``: conv ids of each node's first ``child``, next ``sibling`` and ``parent``, and whether there is one.  Arc 2i enters node i, 2i + 1 leaves it.  Returns of each arc its
    piece's first arc and the sums of ``weights`` (arcs, sums) from it to the piece's end; first arcs; and of each first arc (conv, depth, kind, there)
    of the arc that comes after its piece.
    """
    n = len(conv)
    own, start, held = np.unique(conv, return_index=True, return_counts=True)

    def place(c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The row of node (c, d), or -1: the rows of a conversation in one range are of consecutive depths."""
        at = np.minimum(np.searchsorted(own, c), len(own) - 1)
        off = d - depth[start[at]]
        row = np.where((own[at] == c) & (off >= 0) & (off < held[at]), start[at] + off, -1)
        return np.where((row >= 0) & (depth[row] == d), row, -1)

    (child, has_child), (sibling, has_sibling), (parent, has_parent) = (to[c] for c in ("child", "sibling", "parent"))
    target = np.zeros((2 * n, 3), np.int64)  # conv, depth, kind
    target[0::2] = np.stack([np.where(has_child, child, conv), np.where(has_child, depth + 1, depth), np.where(has_child, 0, 1)], 1)
    target[1::2] = np.stack([np.where(has_sibling, sibling, parent), np.where(has_sibling, depth, depth - 1), np.where(has_sibling, 0, 1)], 1)
    there = np.ones(2 * n, bool)
    there[1::2] = has_sibling | has_parent
    row = np.where(there, place(target[:, 0], target[:, 1]), -1)
    after = np.where(row >= 0, 2 * row + target[:, 2], -1)

    sums, last, jump = weights.copy(), np.arange(2 * n), after.copy()
    while (on := np.flatnonzero(jump >= 0)).size:
        sums[on] += sums[jump[on]]
        last[on] = last[jump[on]]
        jump[on] = jump[jump[on]]
    led_to = np.zeros(2 * n, bool)
    led_to[after[after >= 0]] = True
    first = np.flatnonzero(~led_to)
    first_of = np.zeros(2 * n, np.int64)
    first_of[last[first]] = first
    return first_of[last], sums, first, target[last[first]], there[last[first]]


def toured(nodes: DataFrame, n: int, *, range_rows: int = NODES_A_RANGE) -> DataFrame:
    """``nodes`` (conv_id, depth, node, parent_conv_id, child, sibling, leaf, saved) with ``enter`` and ``exit``, the places of their arcs in the tour from 0, and
    ``n_leaves`` and ``saved_tokens``, the sums of their subtrees."""
    carried = [f.name for f in nodes.schema]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    piece = "struct<kind:int,piece:long,next_conv:long,next_depth:long,next_kind:int," + ",".join(f"{s}:long" for s in SUMS) + ">"
    arcs = ", ".join(f"{side}_piece long, " + ", ".join(f"{side}_{s} long" for s in SUMS) for side in ("enter", "exit"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(map(len, held)):
            return
        table = pa.Table.from_batches(held).combine_chunks()
        number = lambda c: table[c].fill_null(0).to_numpy().astype(np.int64)
        there = lambda c: table[c].is_valid().to_numpy()
        to = {c: (number(x), there(x)) for c, x in (("child", "child"), ("sibling", "sibling"), ("parent", "parent_conv_id"))}
        weights = np.zeros((2 * len(table), len(SUMS)), np.int64)
        weights[:, 0] = 1
        weights[0::2, 1], weights[0::2, 2] = number("leaf"), number("saved")
        of, sums, first, after, more = local_ranks(number("conv_id"), number("depth"), to, weights)
        offset = table["range"][0].as_py() << 40
        opens: list[list[dict]] = [[] for _ in range(len(table))]
        for arc, (c, d, kind), on in zip(first.tolist(), after.tolist(), more.tolist(), strict=True):
            far = {"next_conv": c, "next_depth": d, "next_kind": kind} if on else {}
            opens[arc // 2].append({"kind": arc % 2, "piece": offset + arc, **far, **dict(zip(SUMS, sums[arc].tolist(), strict=True))})
        columns = {c: table[c] for c in carried}
        for k, side in enumerate(("enter", "exit")):
            columns[f"{side}_piece"] = pa.array(offset + of[k::2])
            columns |= {f"{side}_{s}": pa.array(sums[k::2, j]) for j, s in enumerate(SUMS)}
        fields = [("kind", pa.int32()), ("piece", pa.int64()), ("next_conv", pa.int64()), ("next_depth", pa.int64()), ("next_kind", pa.int32())]
        columns["opens"] = pa.array(opens, pa.list_(pa.struct([*fields, *((s, pa.int64()) for s in SUMS)])))
        yield from pa.table(columns).to_batches(max_chunksize=10_000)

    dealt = (
        nodes.repartitionByRange(_ranges(n, range_rows), "conv_id", "depth").sortWithinPartitions("conv_id", "depth")
        .withColumn("range", F.spark_partition_id().cast("long"))
    )
    ranked = checkpointed(dealt.mapInArrow(rank, f"{kinds}, {arcs}, opens array<{piece}>"))
    after = _pieces_ranked(ranked.select("conv_id", "depth", F.explode("opens").alias("o")).select("conv_id", "depth", "o.*"))
    for side in ("enter", "exit"):
        far = after.select(F.col("piece").alias(f"{side}_piece"), *(F.col(s).alias(f"{side}_far_{s}") for s in SUMS))
        ranked = ranked.join(far, f"{side}_piece")
    whole = {f"{side}_{s}": F.col(f"{side}_{s}") + F.col(f"{side}_far_{s}") for side in ("enter", "exit") for s in SUMS}
    # Sums run from an arc to the end of the tour, which has two arcs a node.
    return ranked.select(
        *carried, *((F.lit(2 * n) - whole[f"{side}_arcs"]).alias(side) for side in ("enter", "exit")),
        (whole["enter_leaves"] - whole["exit_leaves"]).alias("n_leaves"), (whole["enter_saved"] - whole["exit_saved"]).alias("saved_tokens"),
    )


def _pieces_ranked(pieces: DataFrame) -> DataFrame:
    """(piece, sums of all that comes after it), by pointer jumping over the list of pieces."""
    head = ["conv_id", "depth", "kind"]
    names = pieces.select(*(F.col(c).alias(to) for c, to in zip(head, ("next_conv", "next_depth", "next_kind"), strict=True)), F.col("piece").alias("next"))
    links, n = settled(
        pieces.join(names, ["next_conv", "next_depth", "next_kind"], "left")
        .select("piece", "next", *SUMS, *(F.col(s).alias(f"own_{s}") for s in SUMS))
    )
    own = [f"own_{s}" for s in SUMS]
    for _ in range(math.ceil(math.log2(max(n, 1)))):
        ahead = links.select(F.col("piece").alias("next"), F.col("next").alias("far"), *(F.col(s).alias(f"far_{s}") for s in SUMS))
        added = (F.col(s) + F.coalesce(F.col(f"far_{s}"), F.lit(0)) for s in SUMS)
        links, _ = settled(links.join(ahead, "next", "left").select("piece", F.col("far").alias("next"), *(a.alias(s) for a, s in zip(added, SUMS, strict=True)), *own))
    return links.select("piece", *((F.col(s) - F.col(f"own_{s}")).alias(s) for s in SUMS))


def build(turns: DataFrame, conversations: DataFrame | None = None, *, turns_a_range: int = TURNS_A_RANGE, nodes_a_range: int = NODES_A_RANGE) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, enter, exit), one row a node, of (conv_id, turn, role, text).

    ``conversations``: (conv_id) of those that may have no turn.  ``saved_tokens`` sums over a subtree (n_convs - 1) times the code points of each node's last text.
    """
    rows = chained(turns, range_rows=turns_a_range)
    given = rows.select("conv_id") if conversations is None else rows.select("conv_id").unionByName(conversations.select(F.col("conv_id").cast("long")))
    ends = (
        given.filter("conv_id IS NOT NULL").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("node"))
        .unionByName(rows.select("conv_id", "depth", "node")).groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    )
    ends = checkpointed(ends)
    root = ends.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("conv_id IS NOT NULL").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), "n_convs", F.lit(0).cast("long").alias("n_chars")
    )
    below = rows.groupBy("node", "depth", "parent").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_chars").alias("n_chars")
    )
    nodes, n = settled(root.unionByName(below))
    salts = salts_for(n)
    salted = nodes.withColumn("salt", salt(salts, "node"))
    families = checkpointed(
        salted.filter("parent IS NOT NULL").groupBy("parent")
        .agg(F.count(F.lit(1)).alias("n_children"), F.min("conv_id").alias("child"), F.collect_set("salt").alias("salts"))
    )
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")).join(families.select("parent", "salts"), "parent")
    parents = parents.select("parent", "parent_conv_id", F.explode("salts").alias("salt"))
    known = (
        _next_siblings(salted, n, nodes_a_range).join(parents, ["parent", "salt"], "left")
        .join(families.select(F.col("parent").alias("node"), "n_children", "child"), "node", "left")
    )
    arcs = known.select(
        "conv_id", "depth", "node", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "child", "sibling",
        F.col("child").isNull().cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"),
    )
    done = toured(arcs, n, range_rows=nodes_a_range).join(ends_hashed(ends), "node", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return done.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"), "enter", "exit"
    )


def with_shared_openings(conversations: DataFrame, *, group: int = 100, most: int = 6, turns_a_range: int = TURNS_A_RANGE) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as others do: (conv_id, turn, role, text), and (conv_id) of all, also of those that are left without a turn.

    Conversation c gets the first h turns of conversation c - c % ``group`` and then its own after its first h; h = crc32(c) % ``most``.
    """
    placed = chained(conversations, carry=("role", "text"), range_rows=turns_a_range).select("conv_id", "depth", "role", "text")
    ids = checkpointed(placed.select("conv_id").distinct())
    h = F.crc32(F.col("conv_id").cast("string")) % most
    opening = placed.filter(F.col("depth") < most).select(F.col("conv_id").alias("base"), F.col("depth").alias("turn"), "role", "text")
    begun = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h")).join(opening, "base").filter("turn <= h")
    own = placed.filter(F.col("depth") > h).select("conv_id", (F.col("depth") + most).alias("turn"), "role", "text")
    return begun.select(own.columns).unionByName(own), ids


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS whole, turn
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT c, text, whole, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(whole)) AS p FROM t),
ids AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT ids.c, p.p AS place, text, whole FROM ids JOIN p ON p.c = ids.c - ids.c % 100 AND p.p <= ids.h
  UNION ALL SELECT p.c, p.p + 6, text, whole FROM p JOIN ids USING (c) WHERE p.p > ids.h),
y AS (
  SELECT c, row_number() OVER w AS d, text, sha256(string_agg(sha256(whole), '') OVER w) AS k FROM r WINDOW w AS (PARTITION BY c ORDER BY place)
  UNION ALL SELECT c, 0, '', 'root' FROM ids),
n AS (SELECT k, d, min(c) AS c, count(*) AS n, (count(*) - 1) * length(any_value(text)) AS saved FROM y GROUP BY k, d),
e AS (SELECT k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, max_by(k, d) AS k FROM y GROUP BY c) GROUP BY k),
up AS (SELECT n.k AS child, y.k AS parent FROM n JOIN y ON y.c = n.c AND y.d = n.d - 1),
fam AS (SELECT parent AS k, count(*) AS n_children FROM up GROUP BY parent),
sub AS (
  SELECT y.k, count(*) FILTER (fam.k IS NULL) AS n_leaves, sum(n.saved) AS saved
  FROM n LEFT JOIN fam ON fam.k = n.k JOIN y ON y.c = n.c AND y.d <= n.d GROUP BY y.k)
SELECT n.c AS conv_id, n.d AS depth, par.c AS parent_conv_id, n.n AS n_convs, coalesce(fam.n_children, 0) AS n_children, sub.n_leaves,
       sub.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n JOIN sub ON sub.k = n.k LEFT JOIN fam ON fam.k = n.k LEFT JOIN e ON e.k = n.k LEFT JOIN up ON up.child = n.k LEFT JOIN n AS par ON par.k = up.parent
"""
