"""The listing source in batch and as a stream against a small server, downloads, and the index that grows by batches."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from papyrine.operators.minhash import sketches
from papyrine.sources import papers
from papyrine.sources.sinks import download
from papyrine.streaming.index import Index, index_stream


@pytest.fixture
def server():
    """Pages /0, /10, .. up to ``pages``; /flaky fails twice; every request's time is kept."""
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            with lock:
                seen.append((time.time(), self.path))
                times = sum(p == self.path for _, p in seen)
            if self.path.startswith("/flaky"):
                status, body = (503 if times <= 2 else 200), "<li>flaky"
            elif self.path.startswith("/busy"):
                status, body = 429, ""
            elif self.path.startswith("/gone"):
                status, body = 404, ""
            else:
                n = int(self.path.strip("/")) // 10
                status, body = 200, f"<li>{n}</li>" if n < state["pages"] else "<p>nothing more"
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    lock, seen, state = threading.Lock(), [], {"pages": 7}
    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_address[1]}", seen, state
    httpd.shutdown()


def listing(spark, **options):
    spark.dataSource.register(papers.Listing)
    return spark.read.format("listing").options(**{k: str(v) for k, v in options.items()}).load()


@pytest.mark.parametrize("readers", [1, 3])
def test_listing_is_read_until_empty_by_default(spark, server, readers):
    base, seen, _ = server
    got = listing(spark, url=base + "/{skip}", size=10, readers=readers, retries=0).collect()
    assert sorted(r.body for r in got) == [f"<li>{k}</li>" for k in range(7)]
    assert len(listing(spark, url=base + "/{skip}", size=10, pages=2, retries=0).collect()) == 2


def test_failures_are_tried_again(spark, server):
    base, seen, _ = server
    got = {r.url[len(base) :]: (r.status, r.body) for r in listing(spark, urls=f"{base}/flaky,{base}/busy,{base}/gone", retries=3, backoff=0.01).collect()}
    assert got == {"/flaky": (200, "<li>flaky"), "/busy": (429, None), "/gone": (404, None)}
    assert {p: sum(q == p for _, q in seen) for p in ("/flaky", "/busy", "/gone")} == {"/flaky": 3, "/busy": 4, "/gone": 1}


@pytest.mark.parametrize("readers", [1, 4])
def test_rate_of_a_host_is_that_asked_for(spark, server, readers):
    """As many tasks as there are: never more than the rate, and not much less."""
    base, seen, state = server
    state["pages"] = 24
    listing(spark, url=base + "/{skip}", size=10, readers=readers, rate=16, retries=0).collect()
    times = sorted(t for t, _ in seen)[:24]
    assert 23 / 16 - 0.2 <= times[-1] - times[0] <= 23 / 16 + 1.5


def test_schedule_counts_by_host():
    schedule = papers.Schedule(2.0, 100.0)
    assert [schedule.next(u) for u in ("http://a/x", "http://b/x", "https://a/y?z", "http://a")] == [100.0, 100.0, 100.5, 101.0]
    assert papers.Schedule(None).next("http://a") == 0.0


def test_listing_stream_restarts_where_it_was(spark, server, tmp_path):
    base, seen, state = server
    spark.dataSource.register(papers.Listing)

    def turn():
        stream = spark.readStream.format("listing").option("url", base + "/{skip}").option("size", 10).option("retries", 0).option("readers", 3).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").start()
        try:
            deadline = time.time() + 60
            while time.time() < deadline and (query.lastProgress is None or spark.read.schema("url string, status int, body string").parquet(str(tmp_path / "out")).count() < state["pages"]):
                time.sleep(0.3)
        finally:
            query.stop()
        return sorted(r.body for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (tmp_path / "out").mkdir()
    assert turn() == sorted(f"<li>{k}</li>" for k in range(7))
    state["pages"] = 12
    assert turn() == sorted(f"<li>{k}</li>" for k in range(12))
    assert turn() == sorted(f"<li>{k}</li>" for k in range(12))


def test_downloads_are_whole_and_paced(spark, server, tmp_path):
    base, seen, _ = server
    rows = [(f"{base}/{10 * k}", str(tmp_path / f"d{k % 2}" / f"{k}.pdf")) for k in range(6)] + [(f"{base}/gone", str(tmp_path / "no.pdf")), ("nonsense", str(tmp_path / "no2.pdf"))]
    got = {r.path: r.status for r in download(spark.createDataFrame(rows, "pdf_url string, paper_path string").repartition(4), rate=10, tasks=2).collect()}
    assert got == {p: "ok" if "/d" in p[len(str(tmp_path)) :] else "error" for _, p in rows}
    assert [(tmp_path / f"d{k % 2}" / f"{k}.pdf").read_text() for k in range(6)] == [f"<li>{k}</li>" for k in range(6)]
    assert sorted(x.name for x in tmp_path.rglob("*") if x.is_file()) == [f"{k}.pdf" for k in range(6)]
    times = sorted(t for t, _ in seen)
    assert times[-1] - times[0] >= (len(times) / 2 - 1) * 0.2 - 0.05


def test_index_after_batches_is_that_of_a_rebuild(spark, tmp_path):
    a, b, c = ("a b c d e f g " * 3, "one two three four five six", "x")
    batches = [
        [("1", a, False, 1), ("2", b, None, 1), ("3", c, False, 1), (None, a, False, 1)],
        [("2", None, True, 2), ("4", a, False, 2), ("1", c, False, 1), ("1", b, False, 2)],
        [("3", None, True, 3), ("3", a, False, 4), ("9", None, True, 1), ("5", None, False, 1), ("6", a, False, 1), ("6", a, True, 1)],
    ]
    want = {"1": b, "4": a, "3": a, "5": None}
    index = Index(spark, f"file://{tmp_path}/index")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id string, text string, deleted boolean, at long")
    rebuilt = lambda: sorted(map(tuple, sketches(spark.createDataFrame(list(want.items()), "doc_id string, text string")).collect()))
    now = lambda: sorted(map(tuple, index.read().collect()))
    assert now() == []
    for k, rows in enumerate(batches):
        index.apply(frame(rows), k)
        index.apply(frame(batches[0]), k)  # comes again, even changed: it's done
    assert now() == rebuilt()
    index.apply(frame(batches[1]), 1)
    assert now() == rebuilt()
    index.compact()
    assert now() == rebuilt() and index.commits() == [("base", 2)]
    index.apply(frame([("5", None, True, 9), ("7", a, False, 9)]), 3)
    del want["5"]
    want["7"] = a
    assert now() == rebuilt() and index.commits() == [("base", 2), ("delta", 3)]
    found = {(r.doc_id, r.other_id, r.shared) for r in index.candidates(frame([("q", a, None, 0)])).collect()}
    assert found == {("q", k, 20) for k in ("3", "4", "7")}


def test_index_stream(spark, tmp_path):
    changes = [[(k, f"text {k} of five words {n}", False, n) for k in range(n, n + 5)] for n in range(3)]
    schema = "doc_id long, text string, deleted boolean, at long"
    index = Index(spark, f"file://{tmp_path}/index", "long")
    for n, rows in enumerate(changes):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        index_stream(stream, index, str(tmp_path / "check")).awaitTermination()
    want = {k: t for rows in changes for k, t, *_ in rows}
    assert sorted(map(tuple, index.read().collect())) == sorted(map(tuple, sketches(spark.createDataFrame(list(want.items()), "doc_id long, text string")).collect()))
    assert len(index.commits()) == 3


def test_command_line_builds_and_extends(spark, tmp_path, monkeypatch):
    import papyrine.__main__ as cli

    folder = tmp_path / "json"
    folder.mkdir()
    paper = lambda n: {"doc_id": f"p{n}", "title": "T", "abstract": f"abstract {n} with five more words", "sections": [{"section_id": "1", "title": "S", "summary": f"body {n}"}], "references": []}
    for n in range(3):
        (folder / f"{n}.json").write_text(json.dumps(paper(n), indent=1))
        assert cli.build_index(spark, str(folder), f"file://{tmp_path}/index") == n + 1
    assert cli.main(["index", "build"]) == 1


def test_detection_from_the_command_line(spark, tmp_path, monkeypatch):
    import papyrine.__main__ as cli
    from papyrine.plans.detect import Settings

    shared = "these very words stand in both of them & more"
    paper = lambda name, text: {"doc_id": name, "title": "T", "abstract": text, "sections": [{"section_id": "1", "title": "S", "summary": f"own words of {name} only here"}], "references": []}
    for folder, some in (("in", {"p/1": f"Intro. {shared} end", "p2": "nothing in common at all here"}), ("corpus", {"c1": f"x {shared} y", "c2": f"{shared}", "c3": "these very words stand in", "p/1": f"Intro. {shared} end"})):
        (tmp_path / folder).mkdir()
        for k, (name, text) in enumerate(some.items()):
            (tmp_path / folder / f"{k}.json").write_text(json.dumps(paper(name, text), indent=1))
    monkeypatch.setenv("PAPYRINE_CANDIDATES", "2")
    assert Settings.load(words=7) == Settings(words=7, candidates=2)
    with pytest.raises(ValueError):
        Settings.load(nonsense=1)
    got = cli.report_reuse(spark, str(tmp_path / "in"), str(tmp_path / "corpus"), str(tmp_path / "out"))
    assert sorted((f[len(str(tmp_path)) :], s) for f, s, _ in got) == [("/out/p_1.html", "ok"), ("/out/p_1.json", "ok")]
    report = json.loads((tmp_path / "out" / "p_1.json").read_text())
    assert report["covered"] == len(shared) and report["parts"] == [{"start": 7, "end": 7 + len(shared)}] and {s["label"] for s in report["spans"]} == {"c1", "c2"}
    page = (tmp_path / "out" / "p_1.html").read_text()
    assert '<mark data-of="c1 c2">these very words stand in both of them &amp; more</mark> end' in page
