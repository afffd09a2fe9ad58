"""Prefix trie of conversations as a z-fast trie held in tables.

A node of the trie is a sequence of first turns that conversations share.  Nodes are known by the hash of their sequence,
which is a running sum over a conversation's turns.  Only compacted nodes are kept while the trie grows: those where
conversations end or part.  Each is filed under its handle, the prefix of its sequence whose length is the two-fattest number
(the one with most trailing zero bits) above its parent's depth.  A conversation finds its exit node by a fat binary search
over its own length: one lookup by equality for each halving.  Conversations go in by batches: what is new below their exit
nodes, together with the edges that it touches, is grouped and gives the new compacted nodes.  In the end totals run up the
compacted tree by pointer doubling, and the edges are expanded to all nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capacast import session
from capacast.operators.joins import join_unique
from capacast.operators.running import running

BATCHES = 2
_LANES = 4
_LOW = (1 << 32) - 1


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, content, bytes): every conversation's turns by number, with a hash of role and text.

    Turns are ordered by turn (null first), then by the hash; a null role or text is empty.  Rows without a conv_id belong
    to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(
        "conv_id", "turn", F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("content"),
        F.octet_length(text).cast("bigint").alias("bytes"))
    counted = running(rows, ["conv_id"], ["turn", "content"], {"depth": ("sum", F.lit(1).cast("bigint"))})
    return counted.select("conv_id", "depth", "content", "bytes")


def spliced(rows: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as another does: the first h turns of conversation c - c % every, then the own turns after
    the first h, where h is crc32(c) % most.  Takes the rows of ``ordered``; returns such rows and all conversation ids, as
    some may be left without turns."""
    rows = session.materialise(rows, "turns")
    sizes = session.materialise(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    first = F.col("conv_id") - F.col("conv_id") % every
    plans = sizes.select("conv_id", taken.alias("h"), first.alias("first")).join(
        sizes.select(F.col("conv_id").alias("first"), F.col("n").alias("held")), "first", "left").select(
        "conv_id", "first", "h", F.least("h", F.coalesce("held", F.lit(0))).alias("got"))
    fronts = rows.where(F.col("depth") < most).withColumnRenamed("conv_id", "first").join(plans, "first").where("depth <= h")
    own = join_unique(rows.where(F.col("depth") > taken), plans.select("conv_id", "h", "got"), "conv_id", ["depth"])
    columns = ["conv_id", "depth", "content", "bytes"]
    moved = own.withColumn("depth", F.col("depth") - F.col("h") + F.col("got"))
    return fronts.select(*columns).union(moved.select(*columns)), sizes.select("conv_id")


def _path(depth: Column, lanes: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[x.cast("string") for x in lanes])))


def _root() -> Column:
    """The path of no turns."""
    return _path(F.lit(0), [F.lit(0)] * _LANES)


def _paths(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, path, up, bytes, before): the hash of the first ``depth`` turns, that of one turn less, and the bytes
    before the turn.  Each of four running sums adds 32 bits of a hash of depth and content, so none overflows."""
    terms = []
    for seed in range(_LANES // 2):
        h = F.xxhash64("depth", "content", F.lit(seed))
        terms += [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(_LOW))]
    termed = rows.withColumns({f"term{i}": t for i, t in enumerate(terms)})
    summed = running(termed, ["conv_id"], ["depth"], {
        **{f"sum{i}": ("sum", f"term{i}") for i in range(_LANES)}, "total": ("sum", "bytes")})
    here = [F.col(f"sum{i}") for i in range(_LANES)]
    earlier = [F.col(f"sum{i}") - F.col(f"term{i}") for i in range(_LANES)]
    return summed.select("conv_id", "depth", _path(F.col("depth"), here).alias("path"),
                         _path(F.col("depth") - 1, earlier).alias("up"), "bytes", (F.col("total") - F.col("bytes")).alias("before"))


def fattest(low: str, high: str) -> Column:
    """The number above ``low`` and not above ``high`` with most trailing zero bits; both are names of bigint columns."""
    return F.expr(f"{high} - pmod({high}, shiftleft(1L, cast(length(bin({low} ^ {high})) - 1 as int)))")


def _exits(ends: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, known): how far the trie's nodes hold each conversation whole, by fat binary search.

    ``ends`` has conv_id and depth (the conversation's length).  A lookup that hits moves on to the node's own depth, one
    that misses gives up all lengths from there on.
    """
    handles = nodes.select("handle", F.col("depth").alias("node_depth"), F.col("above").alias("node_above"),
                           F.col("path").alias("node_path"))
    none = F.lit(None)
    active = ends.select("conv_id", "depth", F.lit(0).cast("bigint").alias("low"), F.col("depth").alias("high"),
                         none.cast("bigint").alias("hit_depth"), none.cast("bigint").alias("hit_above"),
                         none.cast("binary").alias("hit_path"))
    done = []
    while True:
        probes = active.where("low < high").withColumn("probe", fattest("low", "high"))
        probed = probes.join(paths.select("conv_id", F.col("depth").alias("probe"), F.col("path").alias("handle")),
                             ["conv_id", "probe"])
        met = join_unique(probed, handles, "handle", ["conv_id"], "left")
        hit = F.col("node_path").isNotNull()
        active = session.materialise(met.select(
            "conv_id", "depth", F.when(hit, F.least("node_depth", "high")).otherwise(F.col("low")).alias("low"),
            F.when(hit, F.col("high")).otherwise(F.col("probe") - 1).alias("high"),
            *[F.when(hit, F.col(f"node_{x}")).otherwise(F.col(f"hit_{x}")).alias(f"hit_{x}") for x in ("depth", "above", "path")]),
            "search")
        done.append(active.where("low >= high"))
        if active.where("low < high").isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    # The last node hit may reach further than it shares with the conversation; then its parent is the last whole one.
    own = paths.select("conv_id", F.col("depth").alias("hit_depth"), F.col("path").alias("own"))
    whole = F.col("own") == F.col("hit_path")
    return found.join(own, ["conv_id", "hit_depth"], "left").select("conv_id", "depth", F.coalesce(
        F.when(whole, F.col("hit_depth")), F.col("hit_above"), F.lit(0)).alias("known"))


def _filed(found: DataFrame, paths: DataFrame) -> DataFrame:
    """New nodes with what they are looked up by: parent, name (one turn below the parent), handle, and bytes."""
    placed = found.withColumn("fat", fattest("above", "depth"))
    asked = placed.select("path", "conv_id", F.explode(F.array(
        F.struct(F.lit("name").alias("what"), (F.col("above") + 1).alias("at")),
        F.struct(F.lit("handle").alias("what"), F.col("fat").alias("at")),
        F.struct(F.lit("end").alias("what"), F.col("depth").alias("at")))).alias("ask")).select(
        "path", "conv_id", "ask.what", F.col("ask.at").alias("at"))
    answers = asked.join(paths.select("conv_id", F.col("depth").alias("at"), F.col("path").alias("found"), "up", "before",
                                      "bytes"), ["conv_id", "at"]).groupBy("path").agg(
        F.max(F.when(F.col("what") == "name", F.col("found"))).alias("name"),
        F.max(F.when(F.col("what") == "name", F.col("up"))).alias("parent"),
        F.max(F.when(F.col("what") == "name", F.col("before"))).alias("bytes_above"),
        F.max(F.when(F.col("what") == "handle", F.col("found"))).alias("handle"),
        F.max(F.when(F.col("what") == "end", F.col("before") + F.col("bytes"))).alias("bytes_whole"))
    return found.join(answers, "path").select("path", "depth", "above", "conv_id", "parent", "name", "handle", "bytes_above",
                                              "bytes_whole")


def _inserted(nodes: DataFrame | None, ends: DataFrame, paths: DataFrame) -> DataFrame:
    """The compacted nodes once the conversations of ``ends`` (distinct ones, with their lengths) are in."""
    if nodes is None:
        exits = ends.select("conv_id", "depth", F.lit(0).cast("bigint").alias("known"))
    else:
        exits = session.materialise(_exits(ends, paths, nodes), "exits")
    fresh = join_unique(paths.select("conv_id", F.col("depth").alias("at"), "path", "up"),
                        exits.withColumnRenamed("depth", "length"), "conv_id", ["at"]).where("at > known").select(
        "conv_id", F.col("at").alias("depth"), "path", "up", F.col("known").alias("start"),
        (F.col("at") == F.col("length")).alias("kept"))
    if nodes is None:
        rows = session.materialise(fresh, "region")
    else:
        fresh = session.materialise(fresh, "region")
        begun = fresh.where("depth = start + 1").select(F.col("path").alias("name")).distinct()
        touched = session.materialise(nodes.join(begun, "name", "left_semi"), "touched")
        steps = touched.select("conv_id", F.col("depth").alias("end"), F.col("above").alias("start"),
                               F.explode(F.sequence(F.col("above") + 1, "depth")).alias("depth"))
        old = steps.join(paths, ["conv_id", "depth"]).select(
            "conv_id", "depth", "path", "up", "start", (F.col("depth") == F.col("end")).alias("kept"))
        rows = session.materialise(fresh.union(old), "region")
    grouped = session.materialise(rows.groupBy("path").agg(
        F.min("up").alias("up"), F.max("kept").alias("kept"), F.min("conv_id").alias("conv_id")), "grouped")
    parting = grouped.groupBy(F.col("up").alias("path")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    compact = grouped.join(parting, "path", "left").where("kept or n > 1").select("path", F.col("conv_id").alias("first"))
    marked = join_unique(rows, compact, "path", ["conv_id"])
    linked = running(marked, ["conv_id"], ["depth"], {"last": ("max", "depth")}, inclusive=False)
    found = linked.groupBy("path").agg(F.max("depth").alias("depth"), F.max(F.greatest("start", "last")).alias("above"),
                                       F.min("first").alias("conv_id"))
    filed = _filed(session.materialise(found, "compact"), paths)
    if nodes is not None:
        filed = filed.union(nodes.join(touched.select("path"), "path", "left_anti").select(*filed.columns))
    return session.materialise(filed, "nodes")


_SUMS = ["n_convs", "whole", "n_leaves", "edges"]


def _totals(nodes: DataFrame) -> DataFrame:
    """Sums over subtrees by pointer doubling: after k rounds a node has those of its descendants up to 2**k - 1 levels
    down and points 2**k levels up."""
    state = session.materialise(nodes.withColumn("ahead", F.col("parent")), "totals")
    while not state.where("ahead is not null").isEmpty():
        below = state.where("ahead is not null").groupBy(F.col("ahead").alias("path")).agg(
            *[F.sum(c).alias(f"{c}_below") for c in _SUMS], F.min("smallest").alias("smallest_below"))
        joined = state.join(below, "path", "left")
        for c in _SUMS:
            joined = joined.withColumn(c, F.col(c) + F.coalesce(f"{c}_below", F.lit(0)))
        joined = joined.withColumn("smallest", F.least("smallest", "smallest_below")).select(*state.columns)
        pointers = state.where("ahead is not null").select(F.col("path").alias("ahead"), F.col("ahead").alias("further"))
        moved = join_unique(joined, pointers, "ahead", ["path"], "left")
        state = session.materialise(moved.withColumn("ahead", F.col("further")).select(*state.columns), "totals")
    return state


def _digests(ends: DataFrame, groups: DataFrame) -> DataFrame:
    """(path, ends_sha256): the hash of the ascending ids, joined by commas, of the conversations that end at a node.

    A node with one of them needs no task of its own.  For the others ids are sorted by Spark and run through the hash as
    they come, so a task keeps no list; the hash itself is one sequential pass over 8 bytes a conversation.
    """
    single = groups.where("count = 1").select("path", F.sha2(F.col("conv_id").cast("string"), 256).alias("ends_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            paths, done = batch.column("path").to_pylist(), []
            for path, key in zip(paths, batch.column("conv_id").to_pylist()):
                if path != last:
                    if state is not None:
                        done.append((last, state.hexdigest()))
                    last, state = path, hashlib.sha256(str(key).encode())
                else:
                    state.update(b",%d" % key)
            yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in done], pa.binary()),
                                              "ends_sha256": pa.array([d for _, d in done], pa.string())})
        if state is not None:
            yield pa.RecordBatch.from_pydict({"path": pa.array([last], pa.binary()),
                                              "ends_sha256": pa.array([state.hexdigest()], pa.string())})

    several = groups.where("count > 1").select("path")
    listed = join_unique(ends.select("path", F.col("conv_id").cast("bigint").alias("conv_id")), several, "path", ["conv_id"])
    sorted_ends = listed.repartition("path").sortWithinPartitions("path", "conv_id")
    return single.union(sorted_ends.mapInArrow(run, "path binary, ends_sha256 string"))


def build(rows: DataFrame, conversations: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Every node of the prefix trie of ordered turns (columns of ``ordered``; ``conversations`` lists all conv_ids).

    Returns conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes that
    sharing the subtree's turns saves) and ends_sha256.  Equal conversations share all nodes; one without turns ends at the
    root; without any conversation there is no node.  The result does not depend on ``batches``.
    """
    everything = session.materialise(_paths(rows), "paths")
    lasts = everything.groupBy("conv_id").agg(F.max_by(F.struct("path", "depth"), "depth").alias("last"))
    ends = session.materialise(conversations.select("conv_id").distinct().join(lasts, "conv_id", "left").select(
        "conv_id", F.coalesce("last.path", _root()).alias("path"), F.coalesce("last.depth", F.lit(0)).alias("depth")), "ends")
    groups = session.materialise(ends.groupBy("path").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("count"), F.max("depth").alias("depth")), "groups")
    # From here on one conversation stands for all equal ones.
    distinct = groups.where("depth > 0").select("conv_id", "depth")
    paths = session.materialise(join_unique(everything, distinct.select("conv_id"), "conv_id", ["depth"]), "paths")
    batch = F.pmod(F.xxhash64("conv_id"), F.lit(batches))
    nodes = None
    for number in range(batches):
        nodes = _inserted(nodes, distinct.where(batch == number), paths)

    kids = nodes.groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("kids"))
    columns = ["path", "depth", "above", "conv_id", "parent", "bytes_above", "bytes_whole"]
    zero = F.lit(0).cast("bigint")
    root = ends.agg(F.min("conv_id").alias("conv_id")).where("conv_id is not null").select(
        _root().alias("path"), zero.alias("depth"), zero.alias("above"), "conv_id", F.lit(None).cast("binary").alias("parent"),
        zero.alias("bytes_above"), zero.alias("bytes_whole"))
    held = groups.select("path", F.col("conv_id").alias("smallest"), "count")
    n = F.coalesce("count", F.lit(0))
    whole = nodes.select(*columns).union(root).join(held, "path", "left").join(kids, "path", "left").select(
        *columns, "smallest", F.coalesce("kids", F.lit(0)).alias("kids"), n.alias("n_convs"),
        (n * F.col("bytes_whole")).alias("whole"), F.when(F.col("kids").isNull(), 1).otherwise(0).cast("bigint").alias("n_leaves"),
        (F.col("bytes_whole") - F.col("bytes_above")).alias("edges"))
    totals = _totals(whole)
    parents = totals.select(F.col("path").alias("parent"), F.col("smallest").alias("parent_smallest"))
    known = join_unique(totals, parents, "parent", ["path"], "left").join(_digests(ends, groups), "path", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    nodes_out = session.materialise(known, "known")

    # Each node of an edge has the members of the node at its end; what it saves leaves out the turns above it.
    steps = nodes_out.where("depth > 0").withColumn("at", F.explode(F.sequence(F.col("above") + 1, "depth")))
    placed = steps.join(paths.select("conv_id", F.col("depth").alias("at"), "before"), ["conv_id", "at"]).union(
        nodes_out.where("depth = 0").withColumns({"at": zero, "before": zero}).select(
            "conv_id", "at", *[c for c in nodes_out.columns if c != "conv_id"], "before"))
    bottom = F.col("at") == F.col("depth")
    top = F.col("at") == F.col("above") + 1
    return placed.select(
        F.col("smallest").alias("conv_id"), F.col("at").alias("depth"),
        F.when(F.col("at") > 0, F.when(top, F.col("parent_smallest")).otherwise(F.col("smallest"))).alias("parent_conv_id"),
        "n_convs", F.when(bottom, F.col("kids")).otherwise(F.lit(1)).cast("bigint").alias("n_children"), "n_leaves",
        (F.col("whole") - F.col("n_convs") * F.col("before") - F.col("edges") + F.col("before") - F.col("bytes_above")).alias(
            "saved_tokens"),
        F.when(bottom, F.coalesce("ends_sha256", nothing)).otherwise(nothing).alias("ends_sha256"))


def prefix_trie(turns: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Every node of the prefix trie of conversations (conv_id, turn, role, text); see ``ordered`` and ``build``."""
    rows = session.materialise(ordered(turns), "turns")
    return build(rows, rows.select("conv_id").distinct(), batches)


def oracle_sql() -> str:
    """DuckDB form of the query: every prefix as a list of its turns."""
    return """
WITH RECURSIVE given AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
digits AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM given),
crc AS (
  SELECT conv_id, s, 0 AS i, 4294967295::BIGINT AS c FROM digits
  UNION ALL
  SELECT conv_id, s, i + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END
  FROM (SELECT *, CASE WHEN i % 8 = 0 THEN xor(c, ascii(s[i // 8 + 1])::BIGINT) ELSE c END AS x FROM crc WHERE i < 8 * length(s))),
planned AS (SELECT conv_id, xor(c, 4294967295::BIGINT) % 9 AS h, conv_id - conv_id % 5 AS base FROM crc WHERE i = 8 * length(s)),
turns AS (
  SELECT p.conv_id, 0 AS own, g.pos, g.role, g.text FROM planned p JOIN given g ON g.conv_id = p.base AND g.pos <= p.h
  UNION ALL SELECT p.conv_id, 1, g.pos, g.role, g.text FROM planned p JOIN given g ON g.conv_id = p.conv_id AND g.pos > p.h),
numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, role, text FROM turns),
prefixed AS (
  SELECT conv_id, depth, list(sha256(length(role) || ':' || role || text)) OVER so_far AS path, strlen(text) AS bytes
  FROM numbered WINDOW so_far AS (PARTITION BY conv_id ORDER BY depth)
  UNION ALL SELECT conv_id, 0, []::VARCHAR[], 0 FROM planned),
lasts AS (SELECT conv_id, max(depth) AS last FROM prefixed GROUP BY conv_id),
nodes AS (
  SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(bytes) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = last), '')) AS ends_sha256
  FROM prefixed JOIN lasts USING (conv_id) GROUP BY path),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.path[1:n.depth] = n.path) AS kids
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1])
SELECT n.conv_id, n.depth::BIGINT AS depth, n.parent_conv_id, n.n::BIGINT AS n_convs, n.kids::BIGINT AS n_children,
       count(*) FILTER (WHERE d.kids = 0)::BIGINT AS n_leaves, sum(d.saved)::BIGINT AS saved_tokens, n.ends_sha256
FROM linked n JOIN linked d ON d.depth >= n.depth AND d.path[1:n.depth] = n.path
GROUP BY ALL
"""
