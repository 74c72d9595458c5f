"""Prefix trie of conversations, built as a z-fast trie.

A node of the compacted trie is an edge of turns: from depth ``low`` to its extent, the depth ``high`` of the conversation
``rep``. Its handle is the prefix whose length is the 2-fattest number in (low, high], the one divisible by the largest power
of two. Prefixes are known by 128-bit hashes, so the trie is a table of nodes by hash.

1. Every conversation's turns are numbered, and the hash of each prefix is a running sum over them.
2. All conversations that wait look for their exit node by fat binary search: they ask the table for the handle at the
   2-fattest depth of the interval left to them; a hit moves its low end to the extent, a miss its high end below. That takes
   as many rounds as the longest conversation's length has bits.
3. The child by the next turn, if any, and the edge's turns tell the depth at which a conversation leaves the trie.
4. They are inserted as one batch: edges are cut where conversations leave or end; of those that leave at one depth by the same
   turn the longest becomes the new leaf, the others wait for the next batch. One by which turns differ never waits, and
   the longest go first, so growing versions of a dialogue are inserted in two batches.
5. The members of a node are summed up along the nodes of its descendants' paths, and edges are expanded to a row per depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesledger.llm.running import running
from salesledger.llm.staging import staged

FAMILY, HEADS = 20, 4
IDS = 12
"""Members are listed in chunks of ids that agree in all but this number of low bits."""

_WORD = r"[^\\x20\\x09-\\x0D]+"
_FATTEST = "high & shiftleft(-1L, length(bin(low ^ high)) - 1)"
"""SQL of the 2-fattest number in (low, high]."""


def ordered(turns: DataFrame) -> DataFrame:
    """The turns of ``turns`` (conv_id, turn, role, text) as (conv, number, a, b, words), numbered from 1 in each conversation.

    They follow by turn, null first; ties by role, then by the digest of role and text, so repeated rows all stay. A null role or
    text is empty; rows without conv_id are in no conversation and are left out. a and b are the digest, words the number of words
    of the text.
    """
    role, text = "coalesce(CAST(role AS STRING), '')", "coalesce(CAST(text AS STRING), '')"
    digest = f"md5(concat(octet_length({role}), ':', {role}, {text}))"
    known = turns.where("conv_id IS NOT NULL").selectExpr(
        "CAST(conv_id AS BIGINT) AS conv", "turn", f"{role} AS role",
        f"CAST(regexp_count({text}, '{_WORD}') AS BIGINT) AS words", f"{digest} AS digest",
    )
    known = known.selectExpr(
        "conv", "turn", "role", "words",
        "CAST(conv(substring(digest, 1, 16), 16, -10) AS BIGINT) AS a", "CAST(conv(substring(digest, 17), 16, -10) AS BIGINT) AS b",
    )
    return running(staged(known, "turns"), "conv", ["turn", "role", "a", "b"]).select("conv", "number", "a", "b", "words")


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of another: ``ordered`` turns with new numbers, and all (conv, n).

    The first h turns of conv are those of conversation conv - conv % family (all if it has fewer, none if it isn't there), its own
    follow from the one after its first h on, if any; h = crc32(conv) % heads. n may be 0.
    """
    own = staged(turns, "own")
    sizes = own.groupBy("conv").agg(F.max("number").alias("n")).selectExpr(
        "conv", "n", f"conv - conv % {family} AS base", f"crc32(CAST(CAST(conv AS STRING) AS BINARY)) % {heads} AS h"
    )
    bases = sizes.selectExpr("conv AS base", "n AS base_n")
    sizes = staged(
        sizes.join(bases, "base", "left").selectExpr(
            "conv", "base", "h", "least(h, coalesce(base_n, 0L)) AS given", "greatest(n - h, 0L) AS own"
        ),
        "sizes",
    )
    # A base has less than ``heads`` rows here and less than two families of followers.
    first = own.where(f"number < {heads}").withColumnRenamed("conv", "base")
    taken = sizes.select("conv", "base", "given").join(first, "base").where("number <= given")
    rest = own.join(sizes.select("conv", "h", "given"), "conv").where("number > h")
    rest = rest.withColumn("number", F.expr("number - h + given"))
    names = ["conv", "number", "a", "b", "words"]
    return taken.select(*names).unionByName(rest.select(*names)), sizes.selectExpr("conv", "given + own AS n")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every prefix (conv, d, h, words, sum): hash, words of its last turn and of all its turns; with the empty one of d = 0."""
    marked = turns.selectExpr(
        "conv", "number AS d", "words", "xxhash64(number, a, b) AS x", "xxhash64(b, number, a, 'second') AS y", "words AS sum"
    )
    sums = running(staged(marked, "marked"), "conv", ["d"], ["x", "y", "sum"])
    all_ = sums.selectExpr("conv", "d", "named_struct('x', x, 'y', y) AS h", "words", "sum").unionByName(
        convs.selectExpr("conv", "0L AS d", "named_struct('x', 0L, 'y', 0L) AS h", "0L AS words", "0L AS sum")
    )
    return staged(all_, "prefixes")


def _nodes(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes of the table from edges (rep, low, high): hashes at both ends, at the handle and at the name, low + 1."""
    places = edges.withColumn("fat", F.expr(_FATTEST)).selectExpr(
        "*", "inline(array(struct('low' AS kind, low AS d), struct('name' AS kind, low + 1 AS d),"
        " struct('fat' AS kind, fat AS d), struct('high' AS kind, high AS d)))"
    )
    met = places.withColumnRenamed("rep", "conv").join(paths, ["conv", "d"])
    at = lambda kind, value: F.max(F.expr(f"CASE WHEN kind = '{kind}' THEN {value} END"))
    return met.groupBy(F.col("conv").alias("rep"), "low", "high", "fat").agg(
        at("fat", "h").alias("handle"), at("name", "h").alias("name"), at("low", "h").alias("root"), at("high", "h").alias("extent"),
        at("low", "sum").alias("low_sum"), at("high", "sum").alias("high_sum"),
    )


def _exits(waiting: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Where each of ``waiting`` (conv, n) leaves the trie: (conv, n, rep, from_, to_, at), rep null outside any edge."""
    asked = waiting.selectExpr("conv", "n", "0L AS low", "n AS high", "CAST(NULL AS BIGINT) AS rep", "0L AS from_", "0L AS to_", "0L AS sure")
    found = None
    table = nodes.selectExpr("fat AS d", "handle AS h", "rep AS rep_", "low AS low_", "high AS high_")
    while True:
        asked = asked.withColumn("d", F.expr(_FATTEST)).join(paths.select("conv", "d", "h"), ["conv", "d"])
        hit = asked.join(table, ["d", "h"], "left").selectExpr(
            "conv", "n", "IF(rep_ IS NULL, low, high_) AS low", "IF(rep_ IS NULL, d - 1, high) AS high",
            "coalesce(rep_, rep) AS rep", "coalesce(low_, from_) AS from_", "coalesce(high_, to_) AS to_", "IF(rep_ IS NULL, sure, d) AS sure",
        )
        hit = staged(hit, "asked")
        done = hit.where("low >= high").drop("low", "high")
        found = done if found is None else found.unionByName(done)
        asked = hit.where("low < high")
        if asked.isEmpty():
            break
    # The child by the next turn, if the whole extent fits.
    children = nodes.selectExpr("low + 1 AS d", "name AS h", "rep AS rep_", "low AS low_", "high AS high_")
    next_ = found.withColumn("d", F.col("to_") + 1).join(paths.select("conv", "d", "h"), ["conv", "d"], "left")
    found = staged(
        next_.join(children, ["d", "h"], "left").selectExpr(
            "conv", "n", "coalesce(rep_, rep) AS rep", "coalesce(low_, from_) AS from_", "coalesce(high_, to_) AS to_",
            "IF(rep_ IS NULL, sure, d) AS sure",
        ),
        "found",
    )
    # Along the edge, from the depth that is known to fit.
    ahead = found.where("sure < least(n, to_)").selectExpr("conv", "rep", "explode(sequence(sure + 1, least(n, to_))) AS d")
    ahead = ahead.join(paths.select("conv", "d", "h"), ["conv", "d"])
    same = ahead.join(paths.selectExpr("conv AS rep", "d", "h"), ["rep", "d", "h"])
    far = same.groupBy("conv").agg(F.max("d").alias("far"))
    return found.join(far, "conv", "left").selectExpr("conv", "n", "rep", "from_", "to_", "coalesce(far, sure) AS at")


def _inserted(nodes: DataFrame, exits: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with one more batch, and the conversations (conv, n) that still wait."""
    cuts = exits.where("from_ < at AND at < to_").selectExpr("rep", "from_ AS low", "to_ AS high", "at").distinct()
    cuts = staged(cuts, "cuts")
    ends = cuts.selectExpr("rep", "low", "at").unionByName(cuts.selectExpr("rep", "low", "high AS at").distinct())
    pieces = ends.selectExpr("rep", "lag(at, 1, low) OVER (PARTITION BY rep, low ORDER BY at) AS low", "at AS high")
    leaving = exits.where("at < n").withColumn("d", F.col("at") + 1).join(paths.select("conv", "d", "h"), ["conv", "d"])
    first = leaving.groupBy("d", "h").agg(F.max(F.struct("n", F.expr("-conv AS minus"))).alias("top"))
    leaves = staged(first.selectExpr("-top.minus AS rep", "d - 1 AS low", "top.n AS high"), "leaves")
    whole = nodes.join(cuts.select("rep", "low").distinct(), ["rep", "low"], "left_anti")
    grown = staged(whole.unionByName(_nodes(pieces.unionByName(leaves), paths)), "nodes")
    rest = exits.where("at < n").join(leaves.selectExpr("rep AS conv"), "conv", "left_anti").select("conv", "n")
    return grown, staged(rest, "waiting")


def z_fast(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the compacted trie over ``prefixes``: branchings, ends of conversations and leaves, without the root."""
    none = paths.limit(0).selectExpr("conv AS rep", "d AS low", "d AS high")
    nodes = staged(_nodes(none, paths), "nodes")
    waiting = convs.where("n > 0").select("conv", "n")
    while not waiting.isEmpty():
        nodes, waiting = _inserted(nodes, _exits(waiting, nodes, paths), paths)
    return nodes


def _lists(convs: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end at each node, (d, h, ends); hashed as they come, so none is held whole."""
    chunks = convs.groupBy("d", F.col("h.x").alias("x"), F.col("h.y").alias("y"), F.expr(f"shiftright(conv, {IDS})").alias("chunk")).agg(
        F.expr("array_join(transform(array_sort(collect_list(conv)), c -> CAST(c AS STRING)), ',')").alias("ids")
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            rows: list[tuple] = []
            for *key, ids in zip(*(batch[n].to_pylist() for n in ("d", "x", "y", "ids"))):
                if key != last:
                    if last is not None:
                        rows.append((*last, digest.hexdigest()))
                    last, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("d", "x", "y", "ends"), r)) for r in rows], _ENDS)
        if last is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("d", "x", "y", "ends"), (*last, digest.hexdigest())))], _ENDS)

    dealt = chunks.repartition("d", "x", "y").sortWithinPartitions("d", "x", "y", "chunk")
    out = dealt.select("d", "x", "y", "ids").mapInArrow(hashed, "d long, x long, y long, ends string")
    return out.selectExpr("d", "named_struct('x', x, 'y', y) AS h", "ends")


_ENDS = pa.schema([("d", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("ends", pa.string())])


def expanded(nodes: DataFrame, paths: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per node of the whole trie, from its compacted form; see ``prefix_trie``."""
    whole = staged(convs.selectExpr("conv", "n AS d").join(paths.select("conv", "d", "h"), ["conv", "d"]), "whole")
    ends = whole.groupBy("d", "h").agg(F.count(F.lit(1)).alias("n_ends"), F.min("conv").alias("least"))
    children = nodes.groupBy(F.col("low").alias("d"), F.col("root").alias("h")).agg(F.count(F.lit(1)).alias("n_children"))
    known = nodes.selectExpr("rep", "low", "root", "high AS d", "extent AS h", "low_sum", "high_sum")
    known = known.join(ends, ["d", "h"], "left").join(children, ["d", "h"], "left")
    known = staged(known.fillna(0, ["n_ends", "n_children"]), "known")

    # The nodes on the path to each node, itself among them: fewer than the turns of the conversations that end below.
    reps = known.select(F.col("rep").alias("conv")).distinct()
    passed = paths.where("d > 0").select("conv", "d", "h").join(reps, "conv", "left_semi").join(known.select("d", "h"), ["d", "h"])
    above = passed.selectExpr("conv AS rep", "d AS up", "h AS up_h")
    pairs = staged(known.select("rep", "d", "h", "n_ends", "least", "n_children").join(above, "rep").where("up <= d"), "pairs")
    members = pairs.groupBy("up", "up_h").agg(
        F.sum("n_ends").alias("n_convs"), F.min("least").alias("conv_id"), F.sum(F.expr("int(n_children = 0)")).alias("n_leaves")
    )
    edges = staged(known.join(members.withColumnsRenamed({"up": "d", "up_h": "h"}), ["d", "h"]), "edges")
    saved = edges.select("d", "h", F.expr("(n_convs - 1) * (high_sum - low_sum)").alias("worth"))
    below = pairs.where("up < d").join(saved, ["d", "h"]).groupBy("up", "up_h").agg(F.sum("worth").alias("below"))
    parents = edges.selectExpr("d AS low", "h AS root", "conv_id AS parent")

    total = whole.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"))
    of_root = edges.agg(
        F.sum(F.expr("int(low = 0)")).alias("n_children"),
        F.sum(F.expr("int(n_children = 0)")).alias("n_leaves"),
        F.sum(F.expr("(n_convs - 1) * (high_sum - low_sum)")).alias("saved_tokens"),
    )
    # Both sides are sums, one row each.
    top = total.join(F.broadcast(of_root), F.lit(True)).where("n_convs > 0").selectExpr(
        "conv_id", "0L AS depth", "CAST(NULL AS BIGINT) AS parent_conv_id", "n_convs", "coalesce(n_children, 0L) AS n_children",
        "greatest(coalesce(n_leaves, 1L), 1L) AS n_leaves", "coalesce(saved_tokens, 0L) AS saved_tokens",
        "0L AS d", "named_struct('x', 0L, 'y', 0L) AS h",
    )
    first = total.select(F.col("conv_id").alias("first"))
    full = edges.join(below.withColumnsRenamed({"up": "d", "up_h": "h"}), ["d", "h"], "left").join(parents, ["low", "root"], "left")
    full = full.join(F.broadcast(first), F.lit(True))
    steps = full.selectExpr("*", "explode(sequence(low + 1, d)) AS depth").drop("h")
    turns = paths.selectExpr("conv AS rep", "d AS depth", "h", "words", "sum AS so_far")
    rows = steps.join(turns, ["rep", "depth"]).selectExpr(
        "conv_id", "depth", "CASE WHEN depth - 1 > low THEN conv_id WHEN low = 0 THEN first ELSE parent END AS parent_conv_id",
        "n_convs", "IF(depth = d, n_children, 1L) AS n_children", "n_leaves",
        "(n_convs - 1) * (high_sum - so_far + words) + coalesce(below, 0L) AS saved_tokens", "depth AS d", "h",
    )
    listed = rows.unionByName(top).join(_lists(whole), ["d", "h"], "left")
    return listed.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """One row per distinct beginning of a conversation: conv_id, the least that begins so, and depth, its number of turns.

    ``turns`` are those of ``ordered``; ``convs`` (conv, n) adds conversations without a turn, which end at the root. Columns:
    parent_conv_id (null at the root), n_convs (members), n_children, n_leaves (childless nodes of the subtree, itself
    included), saved_tokens (over the subtree, members but one times the words of the last turn) and ends_sha256, the digest of the
    ids of the members that end there, ascending, joined by commas. No conversation gives no row. Conversations of equal turns end
    at one node. A conversation may have any number of turns; no task holds all of one, or all members of a node.
    """
    if convs is None:
        convs = turns.groupBy("conv").agg(F.max("number").alias("n"))
    convs = staged(convs.select("conv", "n"), "convs")
    paths = prefixes(turns, convs)
    return expanded(z_fast(paths, convs), paths, convs)


def oracle_sql(family: int = FAMILY, heads: int = HEADS) -> str:
    """The trie of rebuilt conversations in DuckDB's SQL, by grouping all prefixes."""
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1),
                 lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(i AS INT), 1)) AS BIGINT))),
             lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"""
    return f"""
    WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                          md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
               FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, max(k) AS n, conv_id - conv_id % {family} AS base, {crc} % {heads} AS h FROM o GROUP BY conv_id),
    r AS (SELECT c.conv_id, o.k AS pos, role, text FROM c JOIN o ON o.conv_id = c.base AND o.k <= c.h
          UNION ALL
          SELECT c.conv_id, o.k - c.h + least(c.h, coalesce(b.n, 0)), role, text
          FROM c JOIN o ON o.conv_id = c.conv_id AND o.k > c.h LEFT JOIN c AS b ON b.conv_id = c.base),
    p AS (SELECT conv_id, pos AS d, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w,
                 string_agg(md5(strlen(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS key FROM r
          UNION ALL SELECT conv_id, 0, 0, '' FROM c),
    m AS (SELECT conv_id, max(d) AS n FROM p GROUP BY conv_id),
    n AS (SELECT key, any_value(d) AS d, any_value(w) AS w, min(p.conv_id) AS conv_id, count(*) AS n_convs,
                 coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE d = m.n), '') AS ends
          FROM p JOIN m USING (conv_id) GROUP BY key),
    k AS (SELECT n.*, (SELECT count(*) FROM n AS x WHERE x.d = n.d + 1 AND left(x.key, 32 * n.d) = n.key) AS n_children FROM n),
    s AS (SELECT u.key, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.w) AS saved
          FROM k AS x, unnest(range(0, x.d + 1)) AS t(i) JOIN k AS u ON u.key = left(x.key, CAST(32 * i AS INT)) GROUP BY u.key)
    SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children,
           CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(k.ends) AS ends_sha256
    FROM k JOIN s USING (key) LEFT JOIN k AS u ON k.d > 0 AND u.key = left(k.key, CAST(32 * (k.d - 1) AS INT))"""
