"""Operator 12: ranks within groups, ties and repeated rows included, by multiplicity compression.

1. Identical tuples of (group, pair, tie-breakers) become one row with its count, summed in part before the exchange; a
   tuple that holds a third of all rows is one row from there on.
2. ``prefix.Running`` range-partitions the tuples in order and sums the counts before each one: its first place.
3. Each tuple is exploded into its places, in stretches of ``STRETCH`` that are dealt out again, so every repeated row has a
   pos of its own and a very frequent tuple isn't one task's work.

``tied`` counts the rows of a group with a row's pair. Where only the first places are asked for, tuples whose count in their
own partition passes the limit drop out before anything is joined; the ranks are those of all rows.

Edge cases: null groups are groups; nulls of a key come first or last as its ``Key`` says and are equal; repeated rows all
get a pos; columns that aren't keys, whatever their names, are left out; an empty table gives none. The contract's lines:
a null sale_id never joins the common group, a null vendor_id is a group of its own, null percents come first.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import pick
from papyrine.llm.prefix import Running, before, same

#: Places of one tuple that are exploded in one row's stead.
STRETCH = 10_000


class Key(NamedTuple):
    name: str
    descending: bool = False
    nulls_last: bool = False

    def order(self) -> Column:
        c = F.col(self.name)
        if self.descending:
            return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()
        return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()


def rank(df: DataFrame, groups: list[str], pair: list[Key], then: list[Key], limit: int | None = None, stretch: int = STRETCH) -> DataFrame:
    """A row for each row of ``df``: groups, pair and then, pos (from 1 in order of pair and then) and tied. ``limit``: only pos up to it."""
    tie, rest = [k.name for k in pair], [k.name for k in then]
    names = [*groups, *tie, *rest]
    tuples = pick(df, *names).groupBy(*names).agg(F.count("*").alias("__n"))
    running = Running(tuples, groups, [k.order() for k in [*pair, *then]], ["__n"], "ranks")
    start = F.col(before("__n"))
    runs = running.rows(None if limit is None else start < limit)
    if limit is not None:
        runs = runs.where(start < limit)
    end = start + F.col("__n") if limit is None else F.least(start + F.col("__n"), F.lit(limit))
    runs = runs.select(*names, (start + 1).alias("__from"), end.alias("__to"))
    short = F.col("__to") - F.col("__from") < stretch
    cut = runs.where(~short).withColumn("__at", F.explode(F.sequence("__from", "__to", F.lit(stretch))))
    cut = cut.withColumn("__from", F.col("__at")).withColumn("__to", F.least(F.col("__at") + (stretch - 1), "__to")).drop("__at")
    both = runs.where(short).unionByName(cut.repartition(*names, "__from"))
    placed = both.select(*names, F.explode(F.sequence("__from", "__to")).alias("pos"))
    ties = running.table.groupBy(*groups, *tie).agg(F.sum("__n").alias("tied"))
    return placed.join(ties, same(placed, ties, [*groups, *tie])).select(*(placed[n] for n in names), "pos", "tied")


#: The contract's one group for lines whose sale_id's crc32 is divisible by this.
COMMON = 5
LINE_GROUPS = ["vendor_id", "part", "month"]
LINE_PAIR = [Key("tens", descending=True), Key("percent")]
LINE_THEN = [Key(n, nulls_last=True) for n in ("sale_id", "line_no", "quantity", "amount_cents")]
PLACES = 2


def lines(df: DataFrame) -> DataFrame:
    """The groups, pair and tie-breakers of ``sale_lines``."""
    rows = pick(df, "sale_id", "line_no", "item_id", "vendor_id", "quantity", "amount", "discount", "shipped_at")
    common = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % COMMON == 0, F.lit(False))
    group = lambda c: F.when(common, F.lit(-1)).otherwise(c).cast("long")
    rounded = lambda c: F.floor(100 * F.col(c) + 0.5).cast("long")
    return rows.select(
        group(F.col("vendor_id")).alias("vendor_id"),
        group(F.coalesce(F.col("item_id") % 5, F.lit(-1))).alias("part"),
        group(F.coalesce(100 * F.year("shipped_at") + F.month("shipped_at"), F.lit(-1))).alias("month"),
        F.floor(F.col("quantity") / 10).cast("long").alias("tens"), rounded("discount").alias("percent"),
        F.col("sale_id").cast("long"), F.col("line_no").cast("long"), F.col("quantity").cast("long"), rounded("amount").alias("amount_cents"),
    )


def first_lines(df: DataFrame, places: int = PLACES) -> DataFrame:
    """The lines in the first ``places`` of each group of ``sale_lines``."""
    found = rank(lines(df), LINE_GROUPS, LINE_PAIR, LINE_THEN, places)
    return found.select(*LINE_GROUPS, "pos", F.col("pos").alias("place"), "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")


#: DuckDB has no crc32: eight shifts for each byte.
ORACLE_SQL = f"""
WITH ids AS (SELECT DISTINCT sale_id, CAST(sale_id AS VARCHAR) AS s FROM sale_lines WHERE sale_id IS NOT NULL),
c AS (SELECT sale_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(length(s)), lambda i: [ord(substr(s, i + 1, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
 lambda a, b: CASE WHEN xor(a, b) & 1 = 1 THEN xor(xor(a, b) >> 1, 3988292384) ELSE xor(a, b) >> 1 END)) AS crc FROM ids),
l AS (SELECT sale_id, line_no, vendor_id, item_id, shipped_at, quantity, coalesce(crc % {COMMON} = 0, false) AS common, CAST(floor(quantity / 10.0) AS BIGINT) AS tens, CAST(floor(100 * discount + 0.5) AS BIGINT) AS percent, CAST(floor(100 * amount + 0.5) AS BIGINT) AS amount_cents
 FROM sale_lines LEFT JOIN c USING (sale_id)),
g AS (SELECT CAST(CASE WHEN common THEN -1 ELSE vendor_id END AS BIGINT) AS vendor_id, CAST(CASE WHEN common THEN -1 ELSE coalesce(item_id % 5, -1) END AS BIGINT) AS part,
 CAST(CASE WHEN common THEN -1 ELSE coalesce(100 * year(shipped_at) + month(shipped_at), -1) END AS BIGINT) AS month, tens, percent, sale_id, CAST(line_no AS BIGINT) AS line_no, CAST(quantity AS BIGINT) AS quantity, amount_cents FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS FIRST, percent ASC NULLS FIRST, sale_id ASC NULLS LAST, line_no ASC NULLS LAST, quantity ASC NULLS LAST, amount_cents ASC NULLS LAST) AS pos,
 count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied FROM g)
SELECT vendor_id, part, month, pos, pos AS place, sale_id, line_no, quantity, percent, amount_cents, tied FROM r WHERE pos <= {PLACES}"""
