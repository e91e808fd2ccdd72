"""Edge strings, with expected values worked out by hand."""

import json
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from papyrine.functions import metadata as M
from papyrine.functions import text as T
from papyrine.operators import blocks as B
from papyrine.operators import crawl as C
from papyrine.operators import html as H
from papyrine.operators import segment as S
from papyrine.operators import summarize as summarizer
from papyrine.operators.summarize import lexrank_order, summarize
from papyrine.plans.document import process_documents
from papyrine.sources import papers, sinks
from papyrine.streaming import incremental


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("line,want", [
    ("I think this is prose", "I. think this is prose"), ("mix of things", "MIX. of things"), ("C. elegans grows", "C. elegans grows"), ("III METHODS", "III. METHODS"), ("II) Related: -", "II. Related"),
    ("VI: x", None), ("IIII. x", None), ("I.", None), ("1. x", None), ("", None), ("I. " + "x" * 120, None), ("I. x", None), (None, None)])
def test_roman_headings(spark, line, want):
    assert one(spark, line, S.roman_heading) == want


@pytest.mark.parametrize("text,want", [
    ("a [1, 2] b (Müller, 2020a) c (Doe et al., 2019)", ["[1, 2]", "(Müller, 2020a)", "(Doe et al., 2019)"]), ("[1-3] [1;2] (A & B, 2020) (S, 2020; J, 2021)", []),
    ("(June, 2017)", ["(June, 2017)"]), ("(Doe et al., 2019) [3,4]", ["(Doe et al., 2019)", "[3,4]"]), ("", [])])
def test_citations(spark, text, want):
    assert one(spark, text, M.citations) == want


def sections(spark, md, version):
    return [(s.title, s.paragraphs) for s in one(spark, md, lambda c: S.parse_sections(c, version))]


def test_sections_by_version(spark):
    md = "\n\n# A ##\none\n\n \ntwo\n#  \n## References\n- x"
    assert sections(spark, md, 2) == [("A", ["one", "two\n#"]), ("References", ["- x"])]
    assert sections(spark, md, 1) == [("A ##", ["one", "two"]), ("", []), ("References", ["- x"])]
    assert sections(spark, "pre\n# A\n# B", 2) == [("Preamble", ["pre"]), ("A", []), ("B", [])]
    assert sections(spark, "", 2) == []
    out = one(spark, "# Intro\n[1]\n# References\nr\n# End\nx", lambda c: S.output_sections(S.parse_sections(c, 2), 2))
    assert [(s.section_id, s.title, s.has_citation, s.citation_count) for s in out] == [("1", "Intro", True, 1), ("2", "End", False, 0)]


def test_references_by_version(spark):
    md = "x\nReferences\n- [1] A\nmore\n- [2] B\nAppendix\n- [3] C"
    got = lambda v: [(r.ref_id, r.raw) for r in one(spark, md, lambda c: S.references(c, v))]
    assert got(1) == [("1", "[1] A"), ("2", "more"), ("3", "- [2] B")]
    assert got(2) == [("1", "[1] A more"), ("2", "[2] B")]
    assert one(spark, "user preferences matter", S.reference_block) == "matter"
    assert one(spark, "no list", lambda c: S.references(c, 2)) == []


@pytest.mark.parametrize("text,want", [
    ("Published: 01/05/2024", ""), ("Published: 13/05/2024", "2024-05-13"), ("Date: 05-13-2024", "2024-05-13"), ("2023-02-31", "2023-02-31"), ("CVPR-2023", "2023-06-01"), ("ACM MM 2021", "2021-10-01"),
    ("March, 2021", "2021-03-01"), ("xCVPR 2023", ""), ("Published: 01/05/2024 in May 2020", "2020-05-01"), ("", "")])
def test_dates(spark, text, want):
    assert one(spark, text, M.publish_date) == want


def test_abstract_and_title(spark):
    assert one(spark, "## Abstract\n\nfoo bar\nbaz\n\n1. Introduction", M.abstract) == "foo bar\nbaz"
    assert one(spark, "Abstract- only no end", M.abstract) == ""
    assert one(spark, "the abstraction layer\n\nx", M.abstract) == "ion layer"
    assert one(spark, "ABSTRACT: foo\nKeywords: a", M.abstract) == "foo"
    assert one(spark, "# On arXiv preprints of old\n## Abstract\n# A title that is good ##\n", M.paper_title) == "A title that is good"
    assert one(spark, "short\nthis line is long enough to be taken, I say\n", M.paper_title) == "this line is long enough to be taken, I say"
    assert one(spark, "x", M.paper_title) == "Untitled"
    assert one(spark, "a\nÉcole, Example University of X\n", M.organization) == "École, Example University of X"


def test_small_functions(spark):
    assert [one(spark, str(n), lambda c: T.to_roman(c.cast("int"))) for n in (0, 4, 1994, 3999)] == ["I", "IV", "MCMXCIV", "MMMCMXCIX"]
    assert one(spark, "/a/b.c/my päper.v1.pdf", lambda c: T.document_id(c, F.lit("20240101"))) == "paper_my_p_per_v1_20240101"
    assert one(spark, "  xii: t", T.leading_roman) == "XII"
    assert one(spark, " a  b\x1c", T.strip) == "a  b"
    assert one(spark, "Title:  A\n b", H.squeeze_title) == "A b"
    cases = {"x.pdf": "http://h/a/x.pdf", "/r": "http://h/r", "//o/z": "http://o/z", "https://q": "https://q", "#f": "http://h/a/b?c#f", "?n": "http://h/a/b?n", "": "http://h/a/b?c"}
    assert {k: one(spark, k, lambda c: H.resolve(F.lit("http://h/a/b?c"), c)) for k in cases} == cases


def test_html(spark):
    html = '<script>var t="</p><a href=\'no\'>";</script><p>A &amp; B</p><a class="x" href="/i.pdf"> in <b>it</b></a><a href="j">j</a>'
    assert one(spark, html, lambda c: H.stripped_text(H.find_first(c, "p"))) == "A & B"
    assert [(x.href, x.anchor) for x in one(spark, html, H.links)] == [("/i.pdf", "in it"), ("j", "j")]
    assert one(spark, html, lambda c: H.first_link(c, r"\.pdf$")) == "/i.pdf"
    assert one(spark, "none", lambda c: H.first_link(c, "x")) is None


def test_merge_blocks_is_a_fold(spark):
    import random

    rnd, rows, want = random.Random(4), [], []
    for doc in range(6):
        for page in range(3):
            blocks = sorted((float(rnd.randint(0, 200)), i) for i in range(rnd.randint(0, 25)))
            last = None
            for y0, i in blocks:
                x0, x1, y1 = float(i % 4), float(10 + i % 7), y0 + rnd.randint(0, 15)
                rows.append((doc, page, i, x0, y0, x1, y1, f"t{i}"))
                if last and abs(y0 - last[5]) < 10:
                    last[4], last[5], last[6] = max(last[4], x1), y1, f"{last[6]} t{i}"
                else:
                    last = [doc, page, x0, y0, x1, y1, f"t{i}"]
                    want.append(last)
    df = spark.createDataFrame(rows, "doc_id int, page int, block_idx int, x0 double, y0 double, x1 double, y1 double, text string")
    got = [[r.doc_id, r.page, r.x0, r.y0, r.x1, r.y1, r.text] for r in B.merge_blocks(df).collect()]
    assert sorted(got) == sorted(want)


def test_resume_takes_the_first_of_new_titles(spark):
    candidates = spark.createDataFrame([("a", 3, "p3"), ("a", 1, "p1"), ("b", 2, "p2")], "paper_name string, at int, paper_path string")
    known = spark.createDataFrame([("b",), ("b",)], "paper_name string")
    assert [tuple(r) for r in C.new_by_title(candidates, known, "at").collect()] == [("a", 1, "p1")]


def test_listing_pages_cross_ranges(spark):
    got = C.listing_pages(spark.createDataFrame([(i * 7,) for i in range(95)], "k long"), "k", 10, width=50).collect()
    assert sorted((r.k, r.listing_page) for r in got) == [(i * 7, i // 10) for i in range(95)]


def test_summaries(spark):
    assert one(spark, "Alpha beta. Alpha gamma. Gamma delta.", lambda c: summarize(c, 1)) == "Alpha gamma."
    assert one(spark, "", summarize) is None and one(spark, None, summarize) is None
    assert lexrank_order(["a b", "a b", "c"]) == [0, 1, 2]


def test_state_files_and_exports(spark, tmp_path):
    assert papers.load_state(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "s.json").write_text(json.dumps([{"paper_name": "a", "workshop_or_main": "main"}, {"paper_name": "b", "year": "2020"}]))
    rows = {r.paper_name: r for r in papers.load_state(spark, str(tmp_path / "s.json")).collect()}
    assert rows["a"].workshop_or_main_conference == "main" and rows["b"].year == "2020"
    docs = process_documents(spark.createDataFrame([("d1", "# A long title here\ny [1]")], "doc_id string, markdown string"))
    out = sinks.export_documents(docs.withColumn("name", F.col("doc_id")), str(tmp_path / "out")).collect()
    assert out[0].status == "ok"
    saved = json.loads((tmp_path / "out" / "d1_processed.json").read_text())
    assert saved["sections"][0]["citation_count"] == 1 and list(saved) == ["doc_id", "title", "abstract", "sections", "references"]
    sinks.save_table(docs, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).schema.names == papers.PROCESSED.names


def test_conversion_failures_are_rows(spark, tmp_path):
    import time

    for name, content in (("a", b"ok"), ("b", b"bad"), ("c", b"slow")):
        (tmp_path / f"{name}.pdf").write_bytes(content)
    (tmp_path / "x.txt").write_text("no")

    def make(options):
        def convert(content: bytes) -> str:
            if content == b"bad":
                raise ValueError("broken")
            time.sleep(20 if content == b"slow" else 0)
            return "# " + content.decode()

        return convert

    files = papers.pdf_files(spark, str(tmp_path))
    got = {r.path[-5]: r for r in papers.pdf_to_markdown(files, make, papers.ConvertOptions(timeout_s=2)).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "ok", "b": "error", "c": "timeout"} and got["a"].markdown == "# ok" and "broken" in got["b"].message


def test_listing_source_reads_files(spark, tmp_path):
    (tmp_path / "p0").write_text("zero")
    spark.dataSource.register(papers.Listing)
    df = spark.read.format("listing").option("url", f"file://{tmp_path}/p{{skip}}").option("pages", 2).option("size", 1).option("retries", 0).load()
    assert sorted((r.url[-2:], r.body) for r in df.collect()) == [("p0", "zero"), ("p1", None)]


def test_streams_process_each_file_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    for k in range(2):
        spark.createDataFrame(pd.DataFrame({"doc_id": [f"d{k}"], "markdown": [f"# A title that is long {k}\nx"]})).coalesce(1).write.mode("append").parquet(src)
        incremental.process_stream(incremental.markdown_stream(spark, src), out, mark).awaitTermination()
        assert spark.read.parquet(out).count() == k + 1
    names = str(tmp_path / "names")
    for batch in ([("a", "1"), ("a", "2")], [("a", "3"), ("b", "4")]):
        spark.createDataFrame(batch, "paper_name string, paper_path string").coalesce(1).write.mode("append").parquet(names)
        stream = spark.readStream.schema("paper_name string, paper_path string").parquet(names)
        incremental.resume_stream(stream, str(tmp_path / "new"), str(tmp_path / "m2")).awaitTermination()
    assert sorted(r.paper_name for r in spark.read.parquet(str(tmp_path / "new")).collect()) == ["a", "b"]


def plain_lexrank(texts):
    import math
    import re
    from collections import Counter

    import numpy as np

    bags = [Counter(re.findall(r"[^\W_]+", t.lower())) for t in texts]
    df = Counter(w for b in bags for w in b)
    x = np.array([[b[w] * (math.log(len(texts) / df[w]) + 1) for w in df] for b in bags])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.1).astype(float)
    walk, rank = link / link.sum(1, keepdims=True), np.full(len(texts), 1 / len(texts))
    for _ in range(100):
        rank = 0.15 / len(texts) + 0.85 * walk.T @ rank
    return sorted(range(len(texts)), key=lambda i: (-round(float(rank[i]), 9), i))


def test_long_texts_are_ranked_as_a_whole(spark):
    import random

    rnd = random.Random(7)
    found = [" ".join(f"W{int(rnd.paretovariate(0.6)) % 3000}" for _ in range(rnd.randint(3, 12))) + "." for _ in range(950)]
    best = sorted(plain_lexrank(found)[:2])
    assert one(spark, " ".join(found), summarize) == " ".join(found[i] for i in best)


def test_links_resolve_as_the_library_does(spark):
    from urllib.parse import urljoin

    bases = ["http://h.com/a/b/c?x#y", "http://h.com", "http://h.com/", "https://h.com/a/b/", "http://h.com/a//b"]
    hrefs = ["", "x", "/x", "../x", "../../../x", "./x", "x/./y/../z", "/a/../b", "/..", "..", ".", "../", "x/..", "?q=../z", "#f", "//k.org/p", "mailto:a@b", "x?a=/../b#c/../d", "/a/./", "a//b"]
    found = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string").select("b", "h", H.resolve(F.col("b"), F.col("h")).alias("r")).collect()
    assert [(r.b, r.h, r.r) for r in found if r.r != urljoin(r.b, r.h)] == []


def test_character_references(spark):
    import html

    some = ["&eacute;&#8217;&#x2014;&amp;lt; a & b &nosuch; &amp &#0;&#xD800;&#1114112;", "plain", "", "&hearts;&#128512;&NotEqualTilde;", "&AMP;&#39;&quot;&nbsp;"]
    found = spark.createDataFrame([(x,) for x in some], "x string").select(T.unescape(F.col("x")).alias("y")).collect()
    assert [r.y for r in found] == [html.unescape(x.replace("&amp ", "&amp; ")).replace("a & b", "a & b") if "&amp " not in x else html.unescape(x.replace("&amp ", "@@ ")).replace("@@ ", "&amp ") for x in some]


def test_html_attributes_and_text(spark):
    page = """<div class='x title big'> A <b> b </b>c </div><div class="titles">no</div><div id=k>K</div><div data-class="title">no</div><area href="/no"><a href='/p1'>one</a><a id="z" href=/p2 >two</a>"""
    df = spark.createDataFrame([(page,)], "h string")
    r = df.select(H.find_all(F.col("h"), "div", "class", "title").alias("t"), H.joined_text(H.find_first(F.col("h"), "div", "class", "title")).alias("j"), H.find_first(F.col("h"), "div", "id", "k").alias("k"), H.links(F.col("h")).alias("l")).first()
    assert r.t == [" A <b> b </b>c "] and r.j == "Abc" and r.k == "K" and [tuple(x) for x in r.l] == [("/p1", "one"), ("/p2", "two")]


def test_follow_levels(spark):
    from papyrine.operators.crawl import follow

    links = spark.createDataFrame([("e", "v1"), ("e", "v1"), ("e", "x"), ("v1", "p1"), ("v1", "p2"), ("v2", "p3")], "url string, target string")
    volumes = follow(spark.createDataFrame([("e",)], "url string"), links, "event", lambda t: t.startswith("v"))
    assert {tuple(r) for r in follow(volumes, links, "volume").select("event", "volume", "url").collect()} == {("e", "v1", "p1"), ("e", "v1", "p2")}


def test_listing_until_empty(spark, tmp_path):
    from papyrine.sources.papers import Listing

    spark.dataSource.register(Listing)
    for k in range(7):
        (tmp_path / f"{k * 10}.html").write_text("<p>entry</p>" if k < 6 else "<p>nothing</p>")
    read = lambda n: spark.read.format("listing").option("url", f"file://{tmp_path}/{{skip}}.html").option("size", 10).option("until", "entry").option("readers", n).option("retries", 0).option("delay", "0-0.01").load()
    for n in (1, 4):
        assert sorted(r.url.rsplit("/", 1)[1] for r in read(n).where("body IS NOT NULL").collect()) == sorted(f"{k * 10}.html" for k in range(6))


def test_command_line_isolates_files(spark, tmp_path):
    import json

    from papyrine.__main__ import main, run
    from papyrine.sources.papers import ConvertOptions, pdf_files

    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.pdf").write_bytes(b"bad" if name == "b" else b"good " + name.encode())

    def make(options):
        def convert(content):
            if content == b"bad":
                raise ValueError("no pdf")
            return "# A Title That Is Long\n\n# One\ntext [1]\n# References\n[1] x", 3

        return convert

    report = run(spark, pdf_files(spark, str(tmp_path)), str(tmp_path / "out"), make, ConvertOptions(timeout_s=30))
    assert sorted(status for _, status, _ in report) == ["error", "ok", "ok"]
    made = json.loads((tmp_path / "out" / "a_processed.json").read_text())
    assert made["total_pages"] == 3 and made["source"].endswith("a.pdf") and made["extraction_date"] and made["sections"]
    assert main(["--batch"]) == 1


def test_blocks_and_images_isolate_files(spark, tmp_path):
    from papyrine.sources.papers import pdf_blocks, pdf_images
    from papyrine.sources.sinks import save_images

    class Page:
        def get_text(self, kind):
            return [(0, 1, 2, 3, "text"), (0, 5, 2, 7, "  ")]

        def get_images(self, full):
            return [(9,)]

    class Pdf(list):
        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def extract_image(self, ref):
            return {"image": b"\x89PNG data"}

    def open_pdf(content):
        if content == b"bad":
            raise RuntimeError("broken")
        return Pdf([Page(), Page()])

    files = spark.createDataFrame([("/in/a.pdf", bytearray(b"x")), ("/in/b.pdf", bytearray(b"bad"))], "path string, content binary")
    found = sorted(tuple(r)[:4] + (r.status, r.message) for r in pdf_blocks(files, open_pdf).collect() if r.status == "ok")
    assert found == [("/in/a.pdf", 0, 0, "text", "ok", None), ("/in/a.pdf", 1, 0, "text", "ok", None)]
    assert [(r.path, r.message) for r in pdf_blocks(files, open_pdf).where("status = 'error'").collect()] == [("/in/b.pdf", "RuntimeError: broken")]
    images = pdf_images(files, lambda: lambda data: [("seen", 0.5)], open_pdf)
    assert {(r.path, r.page, r.status, r.ocr_text[0].text if r.ocr_text else None) for r in images.collect()} == {("/in/a.pdf", 0, "ok", "seen"), ("/in/a.pdf", 1, "ok", "seen"), ("/in/b.pdf", None, "error", None)}
    assert {r.status for r in save_images(images, str(tmp_path)).collect()} == {"ok"}
    assert (tmp_path / "a" / "page1_img0.png").read_bytes() == b"\x89PNG data"


def test_converter_options_from_the_environment(monkeypatch):
    from papyrine.sources.papers import ConvertOptions

    monkeypatch.setenv("DOCLING_DEVICE", "mps"), monkeypatch.setenv("DOCLING_OCR", "false")
    assert ConvertOptions.from_environment() == ConvertOptions("mps", False) and ConvertOptions.from_environment(ocr=True).ocr


def test_proceedings_in_two_levels(spark):
    """Volumes of the list only, papers with a title and a file only, known paths left out."""
    site = "https://h.org"
    index = '<a href="/proceedings/1999/">no</a><div class="x field-item even"><a href="/proceedings/2021/">21</a><a href="/proceedings/2021/">again</a><a href="proceedings/v">v</a><a href="/about">no</a></div>'
    block = lambda title, link: f'<div class="paper_wrapper" id=p><div class="title">{title}</div><div class="authors">A</div><div class="details">[<a href="{link}">PDF</a> | <a href="/d/1">Details</a>]</div></div>'
    volumes = {f"{site}/proceedings/2021/": block(" A <b>Study</b>: of x ", "0001.pdf") + block("No file", "0002.html") + '<div class="paper_wrapper"><div class="details"><a href="3.pdf">no title</a></div></div>' + block("Known", "4.pdf"), f"{site}/all/proceedings/v": block("B", "/b.pdf")}
    table = spark.createDataFrame(list(volumes.items()), "url string, html string")
    known = spark.createDataFrame([("2021_Known.pdf",)], "paper_path string")
    found = C.proceedings(spark.createDataFrame([(f"{site}/all/", index)], "url string, html string"), lambda urls: table.join(urls, "url"), known).collect()
    got = sorted((r.paper_name, r.year, r.conference_name, r.workshop_or_main, r.pdf_url, r.paper_path) for r in found)
    assert got == [("AStudy: of x", "2021", "IJCAI 2021", "main", f"{site}/proceedings/2021/0001.pdf", "2021_AStudy of x.pdf"), ("B", "Unknown", "IJCAI Unknown", "main", f"{site}/b.pdf", "Unknown_B.pdf")]


@pytest.mark.parametrize("answer", [[[[[0, 0], ("seen", 0.5)], [[1, 1], ("too", 1)]], None], [{"rec_texts": ["seen", "too"], "rec_scores": [0.5, 1]}], None])
def test_recogniser_reads_both_shapes(answer):
    class Engine:
        def __init__(self, **given):
            assert given == {"use_angle_cls": True, "lang": "en"}

        def ocr(self, path):
            with open(path, "rb") as f:
                assert f.read() == b"image"
            return answer

    from papyrine.sources.papers import paddle_recogniser

    assert paddle_recogniser(make=Engine)(b"image") == ([("seen", 0.5), ("too", 1.0)] if answer else [])


def test_organization_is_tried_once_a_line(spark):
    """A line without an affiliation costs its length, not the square of it."""
    lines = spark.range(1500).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit(" plain words"), 260)).alias("md"))
    started = time.time()
    assert lines.where(M.organization(F.col("md")) != "").count() == 0
    assert time.time() - started < 15
    odd = {"a\nxx College of\nUniversity b": "xx College of", "one school two School" + "x" * 100: "one school two School" + "x" * 80, "é\x85School x\ry": "é\x85School x\ry", "no\n": ""}
    found = spark.createDataFrame([(k,) for k in odd], "md string").select("md", M.organization(F.col("md")).alias("o")).collect()
    assert {r.md: r.o for r in found} == odd


def test_documents_are_ranked_together_as_alone():
    """Short and long ones, without words, links or sentences; with bounds so small that rows and documents are cut."""
    rnd = random.Random(4)
    texts = [[" ".join(f"w{rnd.randrange(30)}" for _ in range(rnd.randrange(1, 9))) + "." for _ in range(rnd.randrange(1, 40))] for _ in range(30)]
    want = [*map(plain_lexrank, texts), [], [0, 1], [0], [0, 2, 1]]
    texts += [[], ["...", "!"], ["a b"], ["a", "...", "a b"]]
    assert summarizer.lexrank_orders(texts) == want
    held, summarizer.HELD = summarizer.HELD, 7
    try:
        assert summarizer.lexrank_orders(texts) == want
    finally:
        summarizer.HELD = held
