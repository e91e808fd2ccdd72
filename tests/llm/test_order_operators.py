"""The prefix trie, ranks with ties and concatenated sequences against plain Python, on awkward rows, hot groups and small sizes."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from papyrine.llm import concat, prefix, queries, ranking, trie

SALES = pa.schema([("sale_id", pa.int64()), ("line_no", pa.int32()), ("item_id", pa.int64()), ("vendor_id", pa.int64()), ("quantity", pa.int32()), ("amount", pa.float64()), ("discount", pa.float64()),
                   ("flag", pa.string()), ("shipped_at", pa.timestamp("us")), ("pos", pa.string()), ("month", pa.string()), ("tens", pa.string())])
TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("depth", pa.string()), ("n_bytes", pa.string())])


def sale_lines():
    rnd, out = random.Random(5), []
    maybe = lambda x, p=0.1: None if rnd.random() < p else x
    for _ in range(600):
        day = maybe(np.datetime64("2024-01-01", "us") + np.timedelta64(rnd.randrange(70), "D"))
        out.append({"sale_id": maybe(rnd.choice([-7, 3, 12, 500, rnd.randrange(40)])), "line_no": maybe(rnd.randrange(4)), "item_id": maybe(rnd.randrange(7)), "vendor_id": maybe(rnd.choice([1, 1, 2])),
                    "quantity": maybe(rnd.randrange(30)), "amount": maybe(rnd.choice([1.005, 2.5, rnd.random() * 9])), "discount": maybe(rnd.choice([0.0, 0.05, 0.1])), "flag": "f",
                    "shipped_at": day.item() if day is not None else None, "pos": "clash", "month": "clash", "tens": "clash"})
    return out + out[:50] * 3 + [out[0]] * 300


def conversations():
    rnd, out = random.Random(6), []
    add = lambda c, k, role, text: out.append({"conv_id": c, "turn": k, "role": role, "text": text, "depth": "clash", "n_bytes": "clash"})
    for c in [*range(0, 60), -3, -5, 1000000007, 91, 92]:
        n = rnd.choice([1, 2, 3, 5, 8, 12, 30])
        shared = rnd.choice([None, "a", "b"])
        for k in range(n):
            add(c, None if k == 0 and rnd.random() < 0.2 else k, rnd.choice(["user", None]) if not shared else "user", f"{shared}{k}é" if shared and k < n - 1 else rnd.choice(["", None, "x", "y z"]))
    for c in range(200, 230):  # each goes a turn further than the one before
        for k in range(c - 198):
            add(c, k, "user", f"deep {k}")
    for c in range(300, 340):
        add(c, 1, "user", "same")
        add(c, 1, "user", "same")
    add(None, 1, "user", "nobody's")
    return out


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    made = {}
    for kind in ("edge", "empty"):
        d = tmp_path_factory.mktemp(kind)
        for name, schema, rows in (("sale_lines", SALES, sale_lines), ("conversations", TURNS, conversations)):
            columns = list(zip(*(tuple(r[n] for n in schema.names) for r in rows()))) if kind == "edge" else [[]] * len(schema)
            pq.write_table(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema), d / f"{name}.parquet")
        made[kind] = str(d)
    return made


@pytest.mark.parametrize("kind", ["edge", "empty"])
@pytest.mark.parametrize(("name", "table"), [("op11_prefix_trie", "conversations"), ("op12_ranking_ties", "sale_lines")])
def test_query_equals_sql(spark, folders, name, table, kind):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folders[kind]}/{table}.parquet'")
    want, found = con.sql(queries.oracle_sql()[name]), queries.queries()[name](spark, folders[kind])
    fields = sorted(want.columns)
    assert fields == sorted(found.columns)
    theirs = sorted((tuple(r[want.columns.index(c)] for c in fields) for r in want.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in fields) for r in found.collect()), key=repr) == theirs
    assert bool(theirs) == (kind == "edge")


def ordered(value, descending=False, nulls_last=False):
    return (nulls_last, 0) if value is None else (not nulls_last, -value if descending else value)


@pytest.mark.parametrize("limit", [None, 7])
@pytest.mark.parametrize("stretch", [3, 10_000])
def test_ranks(spark, limit, stretch):
    """Whole ranks, repeated rows one by one, very frequent tuples and groups over many partitions."""
    rnd = random.Random(limit or 1)
    rows = [(rnd.choice(["x", "x", "x", None, "y"]), rnd.choice([None, 1, 2, 3]), rnd.choice([None, 5, 6]), rnd.choice([None, *range(40)])) for _ in range(1500)] + [("x", 2, 5, 1)] * 700
    df = spark.createDataFrame([(*r, "clash") for r in rows], "g string, a long, b long, c long, pos string")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = ranking.rank(df, ["g"], [ranking.Key("a", descending=True), ranking.Key("b")], [ranking.Key("c", nulls_last=True)], limit, stretch).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, seen = Counter(), Counter()
    tied = Counter(r[:3] for r in rows)
    for r in sorted(rows, key=lambda r: (ordered(r[1], True), ordered(r[2]), ordered(r[3], nulls_last=True))):
        seen[r[0]] += 1
        if limit is None or seen[r[0]] <= limit:
            want[(*r, seen[r[0]], tied[r[:3]])] += 1
    assert Counter(map(tuple, found)) == want


def test_running_totals_over_many_partitions(spark, monkeypatch):
    """Blocks of partitions, groups of one value or none, totals of nothing, NaN as a group."""
    monkeypatch.setattr(prefix.earlier, "__defaults__", (3,))
    rnd = random.Random(2)
    rows = [(rnd.choice([None, 1.5, float("nan"), float("nan"), 2.0]), i, rnd.choice([None, 0, 3, 7])) for i in range(900)]
    df = spark.createDataFrame(rows, "g double, i long, v long").repartition(5)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.i: r.before_v for r in prefix.Running(df, ["g"], [prefix.F.col("i")], ["v"], "test").rows().collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sums = defaultdict(int)
    for g, i, v in rows:
        key = "nan" if g is not None and math.isnan(g) else g
        assert found[i] == sums[key]
        sums[key] += v or 0


def plain_trie(rows):
    by = defaultdict(list)
    for r in rows:
        if r["conv_id"] is not None:
            role, text = r["role"] or "", r["text"] or ""
            by[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in by.items()}
    nodes = defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
        for d in range(len(whole) + 1):
            nodes[tuple(whole[:d])].append((c, len(whole)))
    kids = defaultdict(list)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    sums = {}
    for k in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0
        sums[k] = (own + sum(sums[x][0] for x in kids[k]), sum(sums[x][1] for x in kids[k]) or 1)
    least = {k: min(v)[0] for k, v in nodes.items()}
    ends = {k: hashlib.sha256(",".join(str(c) for c, n in sorted(v) if n == len(k)).encode()).hexdigest() for k, v in nodes.items()}
    return sorted((least[k], len(k), least[k[:-1]] if k else None, len(v), len(kids[k]), sums[k][1], sums[k][0], ends[k]) for k, v in nodes.items())


def test_trie(spark, folders, monkeypatch):
    """Copies, chains that nest thirty deep, turnless conversations and odd rows; ends joined in short stretches."""
    monkeypatch.setattr(trie, "STRETCH", 7)
    monkeypatch.setattr(trie, "FREQUENT", 5)
    tables = spark.catalog.listTables()
    found = trie.trie(spark.read.parquet(f"{folders['edge']}/conversations.parquet")).collect()
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted(tuple(r[c] for c in columns) for r in found) == plain_trie(conversations())
    assert spark.catalog.listTables() == tables


DOCS = [(1, "hello world " * 300), (2, None), (None, "b"), (3, ""), (1, "hello world " * 300), (4, "<|endoftext|> x"), (5, "日本 é " * 500), *((k, "w " * (k % 40)) for k in range(10, 90))]


@pytest.mark.parametrize("capacity", [1024, 64, 1])
@pytest.mark.parametrize("starts", [concat.BROADCAST_STARTS, 0])
def test_concatenated_sequences(spark, capacity, starts):
    """Pieces tile every document and every sequence; sequences are full but for powers of two at the end."""
    docs = spark.createDataFrame([(i, *d, "clash") for i, d in enumerate(DOCS)], "n long, doc_id long, text string, offset string").repartition(7, "n")
    found = concat.concat_pack(docs, capacity, with_ids=True, broadcast_starts=starts).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in DOCS]
    by_sequence, joined = defaultdict(list), {}
    for r in found:
        by_sequence[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length > 0
    for k in sorted(by_sequence):
        at = 0
        for r in sorted(by_sequence[k], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
            if r.start == 0:
                joined[k, r.offset] = (r.doc_id, r.doc_tokens, bytearray())
            last = joined[max(joined)]
            assert (last[0], last[1], len(last[2]) // 4) == (r.doc_id, r.doc_tokens, r.start)
            last[2].extend(r.ids)
    plain = sorted(((i, len(x), np.array(x, "<u4").tobytes()) for i, x in want), key=repr)
    assert sorted(((i, n, bytes(b)) for i, n, b in joined.values()), key=repr) == plain
    sizes = [sum(r.length for r in by_sequence[k]) for k in sorted(by_sequence)]
    total = sum(n for _, n, _ in plain)
    tail = sizes[total // capacity :]
    assert sizes[: total // capacity] == [capacity] * (total // capacity) and sum(sizes) == total
    assert sorted(by_sequence) == list(range(len(sizes))) and tail == sorted({1 << k for k in range(12) if total % capacity >> k & 1}, reverse=True)


def test_concatenating_nothing(spark):
    assert concat.concat_pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize(("total", "capacity", "want"), [(0, 8, []), (8, 8, []), (13, 8, [12, 13]), (7, 8, [4, 6, 7]), (999, 1000, [512, 768, 896, 960, 992, 996, 998, 999])])
def test_ends(total, capacity, want):
    assert concat.ends(total, capacity).tolist() == want
