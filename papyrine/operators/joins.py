"""Helpers of joins and of work in stages: hot keys by checked broadcast, stored intermediate tables, components of links."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than one row of so many is hot. There are fewer hot keys than this, so a row each can be broadcast.
HOT = 400
#: Bytes of a hot key's payload that are broadcast at most, so all of them take 40 MB at most.
HOT_BYTES = 100_000
#: Spark's limit of an Arrow batch that goes to Python.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bits of a bitmap of keys.
MARKS = 1 << 27
#: Classes of a chunk, and those that a group of blocks holds, on average.
TOGETHER, HELD = 200, 1_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a local session takes a temporary one and a cluster fails."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}{os.sep}papyrine-stages"


def stored(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """``df``, written once to the shared folder and read from there: what follows neither repeats it nor depends on its executors.

    ``batch_bytes``: about what Python gets in an Arrow batch meanwhile, so that its memory doesn't follow the size of a task.
    """
    folder = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(BATCH_BYTES)
    if batch_bytes:
        conf.set(BATCH_BYTES, str(batch_bytes))
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        if batch_bytes:
            conf.set(BATCH_BYTES, before)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def look_up(rows: DataFrame, table: DataFrame, key: str, weight: str, how: str = "inner", payload: str | None = None) -> DataFrame:
    """``rows`` joined with ``table`` (a row for each ``key``, ``weight``: at most how many of ``rows`` have it), inner or left.

    Hot keys are broadcast, so their rows stay where they are; the others are exchanged. ``weight`` isn't returned. Where a
    row of ``table`` has a ``payload`` of any length, hot ones longer than HOT_BYTES are exchanged as well.
    """
    hot = F.col(weight) > (table.agg(F.sum(weight)).first()[0] or 0) / HOT
    if payload:
        hot &= F.octet_length(payload) <= HOT_BYTES
    sent, rest = table.where(hot).drop(weight), table.where(~hot).drop(weight)
    left = rows.join(F.broadcast(sent.select(key)), key, "left_anti")
    return rows.join(F.broadcast(sent), key).unionByName(left.join(rest, key, how))


def _marked(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``__marked``: false only where ``key`` is not among ``ids``.

    The ids' hashes are set in a bitmap of MARKS bits at most (16 MB), kept in pieces of 32768 bits, and sent to all tasks. The
    more ids, the more rows are marked in vain.
    """
    def bit(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(MARKS))

    pieces = ids.select(bit(ids.columns[0]).alias("m")).distinct().groupBy(F.expr("m div 32768").alias("__piece")).agg(F.expr("bitmap_construct_agg(m % 32768)").alias("__bits"))
    at = bit(key) % 32768
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    here = rows.withColumn("__piece", F.floor(bit(key) / 32768)).join(F.broadcast(pieces), "__piece", "left")
    return here.select(*rows.columns, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias("__marked"))


def only_of(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is in ``ids`` (one column, null is a key): a semi join that exchanges few of the others."""
    ids = ids.select(F.col(ids.columns[0]).alias("__id")).distinct()
    few = _marked(rows, ids, key).where("__marked").drop("__marked")
    return few.join(ids, few[key].eqNullSafe(ids["__id"]), "left_semi")


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is not in ``ids``: an anti join that exchanges few rows but those of ``ids``."""
    ids = ids.select(F.col(ids.columns[0]).alias("__id")).distinct()
    marked = _marked(rows, ids, key)
    few = marked.where("__marked").drop("__marked")
    return marked.where("NOT __marked").drop("__marked").unionByName(few.join(ids, few[key].eqNullSafe(ids["__id"]), "left_anti"))


def blocks(pairs: DataFrame, together: int = TOGETHER, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """``pairs`` with the block in which each is compared, and (block, class): what each block needs.

    Classes with the same least neighbour are dealt to chunks of ``together`` on average; pairs of the same two chunks are in
    one block, so a class of a dense group goes to a few blocks, not to each of its pairs. Blocks share tasks' groups of
    about ``held`` classes.
    """
    ends = pairs.select(F.col("a").alias("class"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("class"), F.col("a").alias("other")))
    least = ends.groupBy("class").agg(F.min(F.least("class", "other")).alias("group"))
    many = least.groupBy("group").agg(F.count("*").alias("n"))
    placed = look_up(stored(least, "groups"), many.withColumn("chunks", F.ceil(F.col("n") / together)), "group", "n")
    placed = stored(placed.select("class", F.xxhash64("group", F.pmod(F.xxhash64("class"), F.col("chunks"))).alias("chunk")).join(ends.groupBy("class").agg(F.count("*").alias("n")), "class"), "chunks")
    half = look_up(pairs.withColumnRenamed("a", "class"), placed, "class", "n").select(F.col("class").alias("a"), "b", F.col("chunk").alias("chunk_a"))
    both = look_up(half.withColumnRenamed("b", "class"), placed, "class", "n").select("a", F.col("class").alias("b"), F.xxhash64("chunk_a", "chunk").alias("block"))
    both = stored(both, "blocks")
    needed = both.select("block", F.col("a").alias("class")).unionByName(both.select("block", F.col("b").alias("class"))).distinct()
    groups = F.lit(1 + needed.count() // held)
    needed = stored(needed.select(F.pmod("block", groups).alias("block"), "class").distinct(), "needed")
    return both.withColumn("block", F.pmod("block", groups)), needed


def components(links: DataFrame, rounds: int = 80) -> DataFrame:
    """(node, root) of the nodes in ``links``' first two columns; root is the least node that a node reaches.

    Contraction: each node moves to the neighbour, or itself, of the least number, and links move with their ends. In every
    other round numbers are random, drawn anew, which leaves a fraction of the nodes whatever the links' shape; in the others
    they are the nodes themselves, so stars around their least node are done in one.
    """
    a, b = links.columns[:2]
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = stored(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    place = stored(edges.select(F.col("u").alias("node"), F.col("u").alias("at")).distinct(), "places")
    for k in range(rounds):
        number = lambda c: F.struct((F.xxhash64(F.lit(k), c) if k % 2 else F.lit(0)).alias("number"), F.col(c).alias("to"))  # noqa: B023, E731
        best = edges.groupBy("u").agg(F.min(number("v")).alias("best"), F.count("*").alias("n"))
        move = stored(best.select("u", F.least("best", number("u"))["to"].alias("to"), "n"), "moves")
        if move.isEmpty():
            break
        half = look_up(edges, move, "u", "n").select(F.col("v").alias("u"), F.col("to").alias("w"))
        whole = look_up(half, move, "u", "n").select(F.col("w").alias("u"), F.col("to").alias("v"))  # links are stored both ways, so n holds for both ends
        edges = stored(whole.where("u <> v").distinct(), "links")
        held = place.groupBy("at").agg(F.count("*").alias("n")).join(move.select(F.col("u").alias("at"), "to"), "at")
        place = stored(look_up(place, held, "at", "n", "left").select("node", F.coalesce("to", "at").alias("at")), "places")
    else:
        raise RuntimeError(f"links were left after {rounds} rounds")
    roots = place.groupBy("at").agg(F.min("node").alias("root"), F.count("*").alias("n"))
    return look_up(place, roots, "at", "n").select("node", "root")
