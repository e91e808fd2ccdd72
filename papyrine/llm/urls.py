"""Operator 10: URL filter by a path-template tree.

Per host, paths become templates from the root down. Segments that name an item by their form (numbers, long mixed codes)
are wildcards at once. At each node that branches, children that are many and rarely repeated become one wildcard, and of
the others those with similar labelled purity are merged: siblings are pooled by twentieths of purity, and neighbouring
pools that a two-proportion test can't tell apart are one. Merged siblings are one node further down. A node's purity is
the share of blocked among its labelled pages, smoothed towards its parent's, and so on up to the host and the whole table;
a page is rejected if its leaf's is high enough. Labels come from the rules: pages that a rule decides are the labelled ones.

Rows are distinct paths, not pages. A node with few of them below it (``LEAVES`` and ``LEAF_BYTES``) is finished by one task,
in plain Python over its sorted partition. Only the others take part in rounds: a round handles the next branching of all of
them at once (what all paths below a node share is skipped) and hands on the children that have become small enough. So the
number of rounds is set by how deep very large nodes branch, not by how deep paths are. A key with a large share of the rows
is joined by a broadcast of bounded size (``join_spread``).

Edge cases: a null url or one without ``://`` has an empty host and path, no rule, and the verdict of its template; pages
without a path have the template ``/``; null page_ids, repeated rows and ties are kept row by row; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.common import join_spread, materialize, pick


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = [UrlRule("allow", "org", "/"), UrlRule("block", "example.org", "/es/"), UrlRule("block", "example.org", "/en/1"), UrlRule("allow", "com", "/fr/"), UrlRule("block", "com", "/de/")]
#: Weight, in pages, of the level above when a purity is smoothed; purity from which a template is rejected.
SMOOTH, REJECT = 5.0, 0.8
#: A node with more children than this, of which each has fewer than ``RARE`` pages on average, has one wildcard child.
CHILDREN, RARE = 20, 5.0
#: Square of the normal quantile below which two purities count as alike; steps of purity in which siblings are pooled.
ALIKE, STEPS = 1.96**2, 20
#: Distinct paths below a node, and their bytes, that one task finishes.
LEAVES, LEAF_BYTES = 5_000, 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[UrlRule] = RULES) -> Column:
    """The text of the longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        out = F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.text)).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """Path segments, item names as wildcards by their form: {n} numbers, {x} codes; a suffix like .html stays."""
    form = lambda s: F.regexp_replace(F.regexp_replace(s, r"^[0-9]+(?=$|\.[a-z]{1,5}$)", "{n}"), r"^(?=[^.]*[0-9])[0-9A-Za-z_-]{12,}(?=$|\.[a-z]{1,5}$)", "{x}")
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), form)


def _smooth(blocked: Column, labelled: Column, above: Column) -> Column:
    return (blocked + F.lit(SMOOTH) * above) / (labelled + F.lit(SMOOTH))


def _totals() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("pages", "labelled", "blocked")]


def _branch(now: DataFrame) -> DataFrame:
    """One round: rows (host, key, prefix, rest, purity, pages, labelled, blocked) one branching further down."""
    ends = now.groupBy("host", "prefix").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"), F.count("*").alias("rows"))
    differ = F.array_position(F.zip_with("lo", "hi", lambda a, b: F.equal_null(a, b)), False)
    ends = ends.select("host", "prefix", "rows", F.when(differ > 0, differ - 1).otherwise(F.size("lo")).cast("int").alias("common"))
    at = join_spread(now, ends, ["host", "prefix"], "rows")
    # of what all paths of a node share the end is known: the first and last path share it too
    skipped = F.concat(F.col("prefix"), F.array_join(F.transform(F.slice("rest", F.lit(1), F.col("common")), lambda s: F.concat(F.lit("/"), s)), ""))
    rest = F.slice("rest", F.col("common") + 1, F.greatest(F.size("rest") - F.col("common"), F.lit(0)))
    at = at.withColumn("prefix", skipped).withColumn("rest", rest).drop("common")
    at = materialize(at.withColumn("child", F.coalesce(F.get("rest", 0), F.lit(""))), "url-round")
    kids = at.groupBy("host", "prefix", "child").agg(*_totals(), F.first("purity").alias("above"), F.count("*").alias("rows"))
    inner = F.col("child") != ""
    wide = kids.groupBy("host", "prefix").agg(F.count(F.when(inner, 1)).alias("children"), F.sum(F.when(inner, F.col("pages"))).alias("beside"))
    wide = wide.select("host", "prefix", F.coalesce((F.col("children") > CHILDREN) & (F.col("beside") < RARE * F.col("children")), F.lit(False)).alias("open"))
    kids = materialize(kids.join(wide, ["host", "prefix"]).withColumn("name", F.when(inner & F.col("open"), F.lit("{*}")).otherwise(F.col("child"))), "url-children")
    named = kids.groupBy("host", "prefix", "name").agg(*_totals(), F.first("above").alias("above"))
    # siblings by steps of purity; neighbouring steps that can't be told apart are one group
    step = F.when((F.col("name") != "") & (F.col("labelled") > 0), F.round(F.col("blocked") / F.col("labelled") * STEPS).cast("int"))
    named = named.withColumn("step", step)
    pools = named.where("step IS NOT NULL").groupBy("host", "prefix", "step").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.count("*").alias("n"))
    order = Window.partitionBy("host", "prefix").orderBy("step")  # at most STEPS + 1 rows
    l0, b0 = F.lag("l").over(order), F.lag("b").over(order)
    share, gap = (b0 + F.col("b")) / (l0 + F.col("l")), b0 / l0 - F.col("b") / F.col("l")
    alike = gap * gap <= F.lit(ALIKE) * share * (1 - share) * (1 / l0 + 1 / F.col("l"))
    pools = pools.withColumn("apart", F.when(alike, 0).otherwise(1)).withColumn("group", F.sum("apart").over(order))
    whole = Window.partitionBy("host", "prefix", "group")
    pools = pools.select("host", "prefix", "step", "group", F.sum("l").over(whole).alias("l"), F.sum("b").over(whole).alias("b"), F.sum("n").over(whole).alias("n"))
    named = named.join(pools, ["host", "prefix", "step"], "left")
    label = F.when(F.col("n") > 1, F.concat(F.lit("{~"), F.col("group").cast("string"), F.lit("}"))).otherwise(F.col("name"))
    purity = _smooth(F.coalesce("b", "blocked"), F.coalesce("l", "labelled"), F.col("above"))
    named = named.select("host", "prefix", "name", F.when(F.col("name") == "", F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), label)).alias("next"), purity.alias("now_purity"))
    moves = kids.select("host", "prefix", "child", "name", "rows").join(named, ["host", "prefix", "name"]).select("host", "prefix", "child", "rows", "next", "now_purity")
    moved = join_spread(at.drop("rows"), materialize(moves, "url-moves"), ["host", "prefix", "child"], "rows")
    rest = F.slice("rest", F.lit(2), F.greatest(F.size("rest") - 1, F.lit(0)))
    done = F.col("child") == ""
    return moved.select("host", "key", F.col("next").alias("prefix"), F.when(done, F.lit(None)).otherwise(rest).alias("rest"), F.col("now_purity").alias("purity"), "pages", "labelled", "blocked")


def finish(prefix: str, purity: float, rests: list[list[str]], counts: list[tuple[int, int, int]]) -> list[tuple[str, float]]:
    """The template and purity of each path below a node: ``rests`` are their segments, ``counts`` their pages, labelled and blocked ones."""
    out: list[tuple[str, float]] = [("", 0.0)] * len(rests)
    smooth = lambda l, b, above: (b + SMOOTH * above) / (l + SMOOTH)
    total = lambda rows: tuple(sum(counts[i][k] for i in rows) for k in range(3))
    nodes = [(prefix, purity, list(range(len(rests))), 0)]
    while nodes:
        prefix, purity, rows, depth = nodes.pop()
        low, high = min((rests[i] for i in rows), key=lambda r: r[depth:]), max((rests[i] for i in rows), key=lambda r: r[depth:])
        end = depth
        while end < min(len(low), len(high)) and low[end] == high[end]:
            end += 1
        prefix, depth = prefix + "".join(f"/{s}" for s in low[depth:end]), end
        kids: dict[str, list[int]] = {}
        for i in rows:
            kids.setdefault(rests[i][depth] if len(rests[i]) > depth else "", []).append(i)
        done = kids.pop("", None)
        if done:
            _, l, b = total(done)
            for i in done:
                out[i] = (prefix or "/", smooth(l, b, purity))
        if len(kids) > CHILDREN and sum(counts[i][0] for k in kids.values() for i in k) < RARE * len(kids):
            kids = {"{*}": [i for k in kids.values() for i in k]}
        steps: dict[int, list[str]] = {}
        sums = {k: total(v)[1:] for k, v in kids.items()}
        for k, (l, b) in sums.items():
            if l:
                steps.setdefault(math.floor(b / l * STEPS + 0.5), []).append(k)
            else:
                nodes.append((f"{prefix}/{k}", smooth(l, b, purity), kids[k], depth + 1))
        groups: list[list[str]] = []
        last = None
        for step in sorted(steps):
            l, b = (sum(sums[k][j] for k in steps[step]) for j in (0, 1))
            if last:
                share, gap = (last[1] + b) / (last[0] + l), last[1] / last[0] - b / l
            if last and gap * gap <= ALIKE * share * (1 - share) * (1 / last[0] + 1 / l):
                groups[-1] += steps[step]
            else:
                groups.append(steps[step])
            last = (l, b)
        for number, group in enumerate(groups, 1):
            below = [i for k in group for i in kids[k]]
            _, l, b = total(below)
            nodes.append((f"{prefix}/{group[0] if len(group) == 1 else f'{{~{number}}}'}", smooth(l, b, purity), below, depth + 1))
    return out


def _finished(rows: DataFrame) -> DataFrame:
    """(host, key, template, purity, pages) of all paths of small nodes (host, key, prefix, rest, purity, pages, labelled, blocked)."""
    names = ["host", "key", "template", "purity", "pages"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []

        def end() -> pa.RecordBatch:
            found = finish(node[1], held[0]["purity"], [r["rest"] for r in held], [(r["pages"], r["labelled"], r["blocked"]) for r in held])
            columns = ([r["host"] for r in held], [r["key"] for r in held], [t for t, _ in found], [p for _, p in found], [r["pages"] for r in held])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64()))], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if node != (row["host"], row["prefix"]):
                    if held:
                        yield end()
                    node, held = (row["host"], row["prefix"]), []
                held.append(row)
        if held:
            yield end()

    return rows.repartition("host", "prefix").sortWithinPartitions("host", "prefix").mapInArrow(run, "host string, key string, template string, purity double, pages long")


def templates(leaves: DataFrame) -> DataFrame:
    """(host, key, template, purity, pages) of stored ``leaves`` (host, key, segments, pages, labelled, blocked)."""
    whole = leaves.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("l"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b")).first()
    prior = (whole.b + 1.0) / (whole.l + 2.0)
    hosts = leaves.groupBy("host").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.count("*").alias("rows"))
    hosts = hosts.select("host", "rows", _smooth(F.col("b"), F.col("l"), F.lit(prior)).alias("purity"))
    now = join_spread(leaves, hosts, ["host"], "rows").select("host", "key", F.lit("").alias("prefix"), F.col("segments").alias("rest"), "purity", "pages", "labelled", "blocked")
    done = None
    while True:
        sizes = now.groupBy("host", "prefix").agg(F.count("*").alias("rows"), F.sum(F.octet_length("key")).alias("bytes"))
        sizes = sizes.withColumn("small", (F.col("rows") <= LEAVES) & (F.col("bytes") <= LEAF_BYTES)).drop("bytes")
        now = materialize(join_spread(now, sizes, ["host", "prefix"], "rows"), "url-nodes")
        ended = _finished(now.where("small").drop("small"))
        done = ended if done is None else done.unionByName(ended)
        now = now.where("NOT small").drop("small")
        if now.isEmpty():
            return done
        now = materialize(_branch(now), "url-nodes")
        ended = now.where("rest IS NULL").select("host", "key", F.when(F.col("prefix") == "", F.lit("/")).otherwise(F.col("prefix")).alias("template"), "purity", "pages")
        done, now = done.unionByName(ended), now.where("rest IS NOT NULL")


def judge(df: DataFrame, rules: list[UrlRule] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, template, purity) for each row."""
    df = pick(df, key, url)
    k = F.col(f"`{key}`")
    pages = df.select(k, host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    verdict = F.create_map(*(F.lit(x) for r in rules for x in (r.text, r.verdict))) if rules else None
    pages = pages.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("segments", segments(F.col("path")))
    label = F.try_element_at(verdict, F.coalesce("rule", F.lit(""))) if rules else F.lit(None).cast("string")
    pages = pages.withColumn("label", label).withColumn("key", F.array_join("segments", "/"))
    counts = [F.count("*").alias("pages"), F.count("label").alias("labelled"), F.count(F.when(F.col("label") == "block", 1)).alias("blocked")]
    leaves = pages.groupBy("host", "key").agg(*counts)
    leaves = materialize(leaves.withColumn("segments", F.when(F.col("key") == "", F.array().cast("array<string>")).otherwise(F.split("key", "/"))), "url-leaves")
    named = materialize(templates(leaves), "url-templates")
    out = join_spread(pages.drop("segments"), named, ["host", "key"], "pages")
    final = F.coalesce("label", F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(k, "host", "path", "rule", final.alias("verdict"), "template", "purity")
