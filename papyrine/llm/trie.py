"""Operator 11: the prefix trie of rebuilt conversations, by its owned chains.

1. Turns get their positions from running totals (``prefix.Running``), so a conversation of any length spreads over tasks;
   each rebuilt conversation takes its opening turns from its base conversation.
2. A prefix's digest is a running total too: four sums of 32-bit hashes of (depth, turn's SHA-256). Equal prefixes and only
   those (up to chance of 2**-100 or so) have equal digests.
3. Prefix-digest minima: each digest's least conversation and its number of them, one aggregation; those of a single
   conversation aren't kept. The least member owns a node, and with a node all deeper ones on its path; so a
   conversation's first owned depth is found by binary search, all conversations at once, a join with the minima a round.
4. A conversation's owned nodes are a chain that hangs on another's node. Chains are summed bottom-up by doubling: a round
   adds what lies 2**k chains below and doubles the reach, so the rounds are logarithmic in the nesting. Running totals
   along each chain, from its end, then give every node's subtree.
5. Ids that end at a node are joined in stretches of ``STRETCH`` and hashed in order as a stream.

Edge cases: a null conv_id is no conversation; null roles and texts are empty; turns of one number (nulls first) are ordered
by the digest of role and text; repeated rows are turns each; a conversation without a base has only its own later turns,
maybe none, and ends at the root; an empty table has no root.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm.common import FREQUENT, join_spread, materialize, pick
from papyrine.llm.prefix import Running, before

#: Conversations whose opening turns come from the first of them, and opening turns at most, and one.
EVERY, OPENINGS = 5, 9
#: Ids of conversations that are joined to one text.
STRETCH = 1000
SUMS = ["s0", "s1", "s2", "s3"]
DIGEST = ["depth", *SUMS]


def opening(conv_id: Column) -> Column:
    """How many opening turns a conversation takes from its base."""
    return F.crc32(conv_id.cast("string").cast("binary")) % OPENINGS


def numbered(df: DataFrame) -> Running:
    """(conv_id, turn_digest, n_bytes) in order, with before_one."""
    role, text = (F.coalesce(n, F.lit("")) for n in ("role", "text"))
    rows = pick(df, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = rows.select(F.col("conv_id").cast("long"), "turn", digest.alias("turn_digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.lit(1).alias("one"), F.monotonically_increasing_id().alias("__id"))
    return Running(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("turn_digest"), F.col("__id")], ["one"], "turns")


def rebuild(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, turn_digest, n_bytes) of the rebuilt turns and (conv_id, length) of all conversations, turnless ones too."""
    running = numbered(df)
    turns = running.rows().withColumn("pos", F.col("before_one") + 1).select("conv_id", "pos", "turn_digest", "n_bytes")
    sizes = running.table.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.withColumns({"opening": opening(F.col("conv_id")), "base": F.col("conv_id") - F.col("conv_id") % EVERY})
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    convs = convs.withColumn("taken", F.least("opening", F.coalesce("base_n", F.lit(0)))).withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("opening"), F.lit(0)))
    convs = materialize(convs.select("conv_id", "n", "opening", "base", "taken", "length"), "conversations")
    own = join_spread(turns, convs.select("conv_id", "n", "opening", "taken"), ["conv_id"], "n").where("pos > opening")
    own = own.select("conv_id", (F.col("pos") - F.col("opening") + F.col("taken")).alias("depth"), "turn_digest", "n_bytes")
    heads = turns.where(F.col("pos") < OPENINGS).withColumnRenamed("conv_id", "base")  # a few rows of each base for a few conversations
    taken = heads.join(convs.select("base", "conv_id", "opening"), "base").where("pos <= opening").select("conv_id", F.col("pos").alias("depth"), "turn_digest", "n_bytes")
    return own.unionByName(taken), convs.select("conv_id", "length")


def prefixes(turns: DataFrame, table: str, parts: int) -> DataFrame:
    """(conv_id, depth, SUMS, n_bytes) of every prefix, stored in buckets of (conv_id, depth), so that probes come to it."""
    hashed = turns.select("conv_id", "depth", "n_bytes", *(F.xxhash64(F.lit(k), "depth", "turn_digest").bitwiseAND(0xFFFFFFFF).alias(s) for k, s in enumerate(SUMS)))
    rows = Running(hashed, ["conv_id"], [F.col("depth")], SUMS, "prefixes").rows()
    rows = rows.select("conv_id", "depth", *((F.col(s) + F.col(before(s))).alias(s) for s in SUMS), "n_bytes")
    rows.repartition(parts, "conv_id", "depth").write.bucketBy(parts, "conv_id", "depth").sortBy("conv_id", "depth").saveAsTable(table)
    return turns.sparkSession.table(table)


def minima(stored: DataFrame) -> DataFrame:
    """(DIGEST, owner, n_convs) of the prefixes that more than one conversation has."""
    return materialize(stored.groupBy(*DIGEST).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs")).where("n_convs > 1"), "minima")


def first_owned(convs: DataFrame, stored: DataFrame, least: DataFrame) -> DataFrame:
    """(conv_id, length, first, above): the first depth whose prefix is owned (length + 1: none), and who owns the prefix before it.

    ``above`` is null where first is 1. Every round halves the depths in question for all conversations.
    """
    total, longest = convs.agg(F.sum("length"), F.max("length")).first()
    often = (total or 0) / FREQUENT
    frequent = F.broadcast(least.where(F.col("n_convs") > often).drop("n_convs"))  # of all prefixes, so fewer than FREQUENT rows
    seldom = least.where(F.col("n_convs") <= often).drop("n_convs")
    state = convs.select("conv_id", "length", F.lit(1).cast("long").alias("lo"), (F.col("length") + 1).alias("hi"), F.lit(None).cast("long").alias("above"))
    for _ in range((longest or 0).bit_length()):
        asked = state.where("lo < hi").withColumn("depth", F.expr("(lo + hi) div 2"))
        asked = asked.join(stored.drop("n_bytes"), ["conv_id", "depth"]).join(frequent, DIGEST, "left")
        met = asked.where("owner IS NOT NULL").unionByName(asked.where("owner IS NULL").drop("owner").join(seldom, DIGEST, "left"))
        owned = F.coalesce(F.col("owner") == F.col("conv_id"), F.lit(True))
        met = met.select("conv_id", "length", F.when(owned, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(owned, F.col("depth")).otherwise(F.col("hi")).alias("hi"), F.when(owned, F.col("above")).otherwise(F.col("owner")).alias("above"))
        state = materialize(state.where("lo >= hi").unionByName(met), "search")
    return state.select("conv_id", "length", F.col("lo").alias("first"), "above")


def subtree_sums(chains: DataFrame, totals: list[str]) -> DataFrame:
    """``chains`` (conv_id, above, totals) with ``totals`` over all chains below as well; above is null at the top."""
    state = materialize(chains.select("conv_id", F.col("above").alias("jump"), *totals), "chains")
    while True:
        moving = state.where("jump IS NOT NULL")
        gain = materialize(moving.groupBy("jump").agg(F.count("*").alias("n"), *(F.sum(t).alias(f"gain_{t}") for t in totals)), "gains")
        if gain.isEmpty():
            return state.drop("jump")
        further = gain.select("jump", "n").join(state.select(F.col("conv_id").alias("jump"), F.col("jump").alias("next")), "jump")
        moved = join_spread(moving.select("conv_id", "jump"), further, ["jump"], "n").select("conv_id", "next")
        below = gain.select(F.col("jump").alias("conv_id"), *(f"gain_{t}" for t in totals))
        state = state.drop("jump").join(moved, "conv_id", "left").join(below, "conv_id", "left")
        state = materialize(state.select("conv_id", F.col("next").alias("jump"), *((F.col(t) + F.coalesce(f"gain_{t}", F.lit(0))).alias(t) for t in totals)), "chains")


def hash_ends(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of ``ends`` (owner, depth, conv_id): the ids in ascending order, joined by commas."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    parts = ends.groupBy("owner", "depth", (F.col("conv_id") - F.pmod("conv_id", F.lit(STRETCH))).alias("stretch")).agg(ids.alias("ids"))
    names = ["owner", "depth", "ends_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for owner, depth, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
                if (owner, depth) == key:
                    state.update(b"," + text.encode())
                    continue
                if key:
                    done.append((*key, state.hexdigest()))
                key, state = (owner, depth), hashlib.sha256(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=names)
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names=names)

    keyed = parts.select("owner", "depth", "ids", "stretch").repartition("owner", "depth").sortWithinPartitions("owner", "depth", "stretch")
    return keyed.mapInArrow(run, "owner long, depth long, ends_sha256 string")


def trie(df: DataFrame) -> DataFrame:
    """A row for each node of ``df``'s (conv_id, turn, role, text)."""
    spark: SparkSession = df.sparkSession
    table, parts = f"prefixes_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns, convs = rebuild(df)
    root, everyone = convs.agg(F.min("conv_id"), F.count("*")).first()
    try:
        stored = prefixes(turns, table, parts)
        least = minima(stored)
        chains = first_owned(convs, stored, least)
        chains = materialize(chains.withColumn("owns", F.col("first") <= F.col("length")), "owned")
        owned = join_spread(stored, chains.drop("owns"), ["conv_id"], "length").where("depth >= first")
        sizes = least.drop("owner")
        owned = owned.join(sizes, DIGEST, "left").withColumn("n_convs", F.coalesce("n_convs", F.lit(1)))
        # lengths come back by the same join, as the count of join_spread is left out
        nodes = materialize(owned.select("conv_id", "depth", "first", "above", "n_convs", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")), "nodes")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    hung = chains.where("owns AND first > 1").groupBy(F.col("above").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("kids"))
    tips = chains.where("owns").select("conv_id", F.col("length").alias("depth"))
    leaves = tips.join(hung, ["conv_id", "depth"], "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    saved = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"))
    whole = chains.where("owns").select("conv_id", "above", "first").join(saved, "conv_id").join(leaves, "conv_id", "left")
    whole = whole.select("conv_id", "above", F.col("saved"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaves"))
    sums = subtree_sums(whole, ["saved", "leaves"])
    tops = chains.where("owns").select("conv_id", "first", F.coalesce("above", F.lit(root)).alias("parent")).join(sums, "conv_id")
    tops = materialize(tops, "tops")
    hung = tops.where("first > 1").groupBy(F.col("parent").alias("conv_id"), (F.col("first") - 1).alias("depth"))
    hung = hung.agg(F.count("*").alias("kids"), F.sum("saved").alias("kids_saved"), F.sum("leaves").alias("kids_leaves"))
    ends = tips.withColumn("tip", F.lit(1))
    rows = nodes.join(hung, ["conv_id", "depth"], "left").join(ends, ["conv_id", "depth"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = rows.select("conv_id", "depth", "first", "above", "n_convs", (zero("kids") + 1 - zero("tip")).alias("n_children"), (F.col("saved") + zero("kids_saved")).alias("at"),
                       F.when((zero("kids") == 0) & (zero("tip") == 1), F.lit(1)).otherwise(zero("kids_leaves")).cast("long").alias("leaf"))
    summed = Running(rows, ["conv_id"], [F.col("depth").desc()], ["at", "leaf"], "subtrees").rows()
    parent = F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.coalesce("above", F.lit(root)))
    summed = summed.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", (F.col("leaf") + F.col("before_leaf")).alias("n_leaves"), (F.col("at") + F.col("before_at")).alias("saved_tokens"))
    top = tops.where("first = 1").agg(F.count("*").alias("n_children"), F.greatest(F.coalesce(F.sum("leaves"), F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
    top = top.where(F.lit(everyone) > 0).select(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(everyone).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens")
    owner = F.when(F.col("length") == 0, F.lit(root)).when(F.col("owns"), F.col("conv_id")).otherwise(F.col("above"))
    hashes = hash_ends(chains.select(owner.alias("owner"), F.col("length").alias("depth"), "conv_id")).withColumnRenamed("owner", "conv_id")
    all_ = summed.unionByName(top).join(hashes, ["conv_id", "depth"], "left")
    return all_.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


#: DuckDB has no crc32: eight shifts for each byte. Each node's subtree is summed over its owner's whole path.
ORACLE_SQL = f"""
WITH d AS (SELECT conv_id, turn, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, h, octet_length(encode(text)) AS n_bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, h) AS pos FROM d),
i AS (SELECT conv_id, count(*) AS n, CAST(conv_id AS VARCHAR) AS s FROM t GROUP BY conv_id),
o AS (SELECT conv_id, n, conv_id - conv_id % {EVERY} AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(length(s)), lambda i: [ord(substr(s, i + 1, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
 lambda a, b: CASE WHEN xor(a, b) & 1 = 1 THEN xor(xor(a, b) >> 1, 3988292384) ELSE xor(a, b) >> 1 END)) % {OPENINGS} AS opening FROM i),
c AS (SELECT o.conv_id, o.opening, o.base, least(o.opening, coalesce(b.n, 0)) AS taken FROM o LEFT JOIN o b ON b.conv_id = o.base),
r AS (SELECT c.conv_id, pos - opening + taken AS depth, h, n_bytes FROM t JOIN c USING (conv_id) WHERE pos > opening UNION ALL SELECT c.conv_id, pos, h, n_bytes FROM c JOIN t ON t.conv_id = c.base AND pos <= opening),
p AS (SELECT conv_id, depth, n_bytes, sha256(string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS k FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
z AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY depth) AS above, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(above) AS above, any_value(n_bytes) AS n_bytes, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM z GROUP BY k, depth),
m AS (SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.above = n.k AND x.depth = n.depth + 1) AS n_children FROM n LEFT JOIN n u ON u.k = n.above AND u.depth = n.depth - 1),
q AS (SELECT p.k, p.depth, sum((m.n_convs - 1) * m.n_bytes) AS saved_tokens, count(*) FILTER (m.n_children = 0) AS n_leaves FROM m JOIN p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY p.k, p.depth)
SELECT conv_id, CAST(m.depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256 FROM m JOIN q USING (k, depth)"""
