"""One registered query for each operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions import metadata as M
from papyrine.functions import patterns as P
from papyrine.functions import text as T
from papyrine.operators import blocks as B
from papyrine.operators import crawl as C
from papyrine.operators import html as H
from papyrine.operators import segment as S
from papyrine.operators.summarize import summarize
from papyrine.plans import similarity
from papyrine.plans.document import corpus_stats, process_documents
from papyrine.plans.oracle import DAY, ORACLE
from papyrine.sources import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

md = "markdown"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _each(name: str, table: Callable[[SparkSession, str], DataFrame], *columns: Callable[[], list]) -> None:
    """A query that only projects."""
    QUERIES[name] = lambda spark, sf_dir: table(spark, sf_dir).select(*columns[0]())


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "pages")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.markdown(spark, sf_dir).select("doc_id", F.posexplode(T.lines(F.col(md))).alias("pos", "line"))


@query
def processed_document(spark, sf_dir):
    d = process_documents(V.markdown(spark, sf_dir))
    sections = F.array_join(F.transform("sections", lambda s: F.concat_ws("|", s["section_id"], s["title"], s["citation_count"].cast("string"))), "\n")
    refs = F.array_join(F.transform("references", lambda r: F.concat_ws("|", r["ref_id"], r["raw"])), "\n")
    return d.select("doc_id", "title", "abstract", sections.alias("sections"), refs.alias("refs"))


@query
def scan_documents(spark, sf_dir):
    return _documents(spark, sf_dir).where("n_chars > 500").select("doc_id", "lang", "source", F.char_length("text").cast("long").alias("n_characters"))


_each("html_title", _pages, lambda: ["page_id", H.stripped_text(H.find_first(F.col("html"), "title")).alias("title")])
_each("html_class_div", _pages, lambda: ["page_id", H.stripped_text(H.find_first(F.col("html"), "div", "class", "ad")).alias("ad")])
_each("html_text", _pages, lambda: ["page_id", H.text_of(H.find_first(F.col("html"), "h1")).alias("raw"), T.squeeze(H.text_of(H.find_first(F.col("html"), "article"))).alias("article")])
_each("html_footer", _pages, lambda: ["page_id", H.text_of(H.find_first(F.col("html"), "footer")).alias("footer"), H.joined_text(H.find_first(F.col("html"), "article")).alias("article")])
_each("url_year", _pages, lambda: ["page_id", H.url_year(F.col("url")).alias("year")])
_each("event_year", _pages, lambda: ["page_id", H.event_year(F.col("url")).alias("year")])
_each("conf_type", _pages, lambda: ["page_id", H.venue_kind(F.col("url")).alias("kind")])
_each("squeeze_title", _documents, lambda: ["doc_id", H.squeeze_title(F.concat(F.lit("Title: "), F.col("text"))).alias("title")])
_each("to_roman", _documents, lambda: ["doc_id", T.to_roman(F.col("doc_id")).alias("roman")])
_each("paper_title", V.markdown, lambda: ["doc_id", M.paper_title(F.col(md)).alias("title")])
_each("organization", V.markdown, lambda: ["doc_id", M.organization(F.col(md)).alias("organization")])
_each("publish_date", V.markdown, lambda: ["doc_id", M.publish_date(F.col(md)).alias("publish_date")])
_each("abstract_v1", V.markdown, lambda: ["doc_id", M.abstract(F.col(md), 1).alias("abstract")])
_each("abstract_v2", V.markdown, lambda: ["doc_id", M.abstract(F.col(md), 2).alias("abstract")])
_each("reference_block", V.markdown, lambda: ["doc_id", S.reference_block(F.col(md)).alias("block")])
_each("lexrank", _documents, lambda: ["doc_id", summarize(F.col("text")).alias("summary")])


@query
def html_links(spark, sf_dir):
    return H.explode_links(_pages(spark, sf_dir)).select("page_id", "pos", "href", "anchor")


@query
def first_matching_link(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", H.first_link(F.col("html"), "/[a-z]+$").alias("href")).where("href IS NOT NULL")


@query
def href_prefix_filter(spark, sf_dir):
    found = H.explode_links(_pages(spark, sf_dir))
    return found.where(F.col("href").startswith("/") & ~F.col("href").contains("#")).select("page_id", "pos", "href")


@query
def href_regex_filter(spark, sf_dir):
    return H.explode_links(_pages(spark, sf_dir)).where(F.col("href").rlike(r"^/[a-z]+[0-9]*/?$")).select("page_id", "pos", "href")


@query
def url_resolve(spark, sf_dir):
    return H.explode_links(_pages(spark, sf_dir)).select("page_id", "pos", H.resolve(F.col("url"), F.col("href")).alias("resolved"))


@query
def distinct_links(spark, sf_dir):
    return H.explode_links(_pages(spark, sf_dir)).select("href").distinct()


@query
def link_expand(spark, sf_dir):
    """Page -> the distinct targets of its own links."""
    found = H.explode_links(_pages(spark, sf_dir)).where(F.col("href").startswith("/"))
    return found.select("page_id", "href", H.resolve(F.col("url"), F.col("href")).alias("target")).distinct()


@query
def crawl_levels(spark, sf_dir):
    """Events -> volumes -> papers, by links that stand for such pages."""
    links = H.explode_links(_pages(spark, sf_dir)).select((F.col("page_id") % 40).alias("url"), ((F.col("page_id") * 7 + F.col("pos") * 3 + F.length("href")) % 40).alias("target"))
    events = links.where("url < 5").select("url").distinct()
    return C.follow(C.follow(events, links, "event", lambda t: t >= 5), links, "volume", lambda t: t % 2 == 0).select("event", "volume", F.col("url").alias("paper"))


@query
def href_substring(spark, sf_dir):
    return H.explode_links(_pages(spark, sf_dir)).where(F.col("href").contains("an")).select("page_id", "pos", "href")


@query
def paper_id_links(spark, sf_dir):
    """Links to papers by their older ids, which every other link of the pages is given here."""
    href = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("/P"), F.col("page_id") % 100, F.lit("-"), F.col("pos") + 1000, F.when(F.col("pos") % 4 == 0, "/").otherwise(""))).otherwise(F.col("href"))
    found = H.explode_links(_pages(spark, sf_dir)).select("page_id", href.alias("href")).where(F.col("href").rlike(P.PAPER_ID))
    return found.select("page_id", H.resolve(F.lit("https://a.example/events/x-2020/"), F.col("href")).alias("paper")).distinct()


@query
def url_resolve_dots(spark, sf_dir):
    dotted = F.concat(F.lit("../x/./y/../"), F.substr("href", F.lit(2)), F.lit("?q=../z"))
    return H.explode_links(_pages(spark, sf_dir)).where(F.col("href").startswith("/")).select("page_id", "pos", H.resolve(F.col("url"), dotted).alias("resolved"))


@query
def html_class_tokens(spark, sf_dir):
    """A class among others, in quotes of either kind or none."""
    html = F.expr("""replace(html, 'class="ad"', CASE page_id % 4 WHEN 0 THEN 'id="a" class="big ad"' WHEN 1 THEN 'class=''ad wide'' id=b' WHEN 2 THEN 'class=ad' ELSE 'class="adx"' END)""")
    return _pages(spark, sf_dir).select("page_id", H.stripped_text(H.find_first(html, "div", "class", "ad")).alias("ad"))


@query
def html_single_quoted_links(spark, sf_dir):
    html = F.expr("""replace(replace(html, '<a href="/t', '<area href="/no"><a class=x href=''/T&amp;'), '">', '" >')""")
    return H.explode_links(_pages(spark, sf_dir).withColumn("html", F.regexp_replace(html, "(href='[^\"]*)\"", "$1'"))).select("page_id", "pos", "href", "anchor")


@query
def proceedings_papers(spark, sf_dir):
    """Papers of volume pages; every page's list items stand for paper blocks here, those of odd places without a file."""
    item = r"(?is)<li>(.*?)</li>"
    block = '<div class="a paper_wrapper"><div class="title"> $1</div><div class="details"><a href="x.html">x</a><a href="/p$1.pdf">PDF</a></div></div>'
    pages = _pages(spark, sf_dir).select("page_id", "url", F.regexp_replace(F.regexp_replace("html", '<a href="/[^"]*">([^<]*)</a>', "$1"), item, block).alias("html"))
    return C.volume_papers(pages).select("page_id", "paper_name", "year", "conference_name", "pdf_url")


@query
def empty_sections(spark, sf_dir):
    return V.markdown(spark, sf_dir).select("doc_id", F.posexplode(S.empty_sections(S.parse_sections(F.col(md), 1))).alias("pos", "title"))


@query
def zip_join(spark, sf_dir):
    pairs = _pages(spark, sf_dir).select("page_id", F.posexplode(H.zip_elements(F.col("html"), "li", "p")).alias("pos", "pair"))
    return pairs.select("page_id", "pos", "pair.first", "pair.second")


def _names(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "url", H.stripped_text(H.find_first(F.col("html"), "title")).alias("paper_name"))


@query
def resume_anti_join(spark, sf_dir):
    n = _names(spark, sf_dir)
    return C.new_by_title(n.where("page_id % 3 <> 0 AND paper_name IS NOT NULL").select("paper_name", "page_id"), n.where("page_id % 3 = 0"), "page_id")


@query
def resume_path_join(spark, sf_dir):
    path = F.concat(F.lit("papers/"), F.element_at(F.split("url", "/"), -1), F.lit(".pdf")).alias("paper_path")
    p = _pages(spark, sf_dir).select("page_id", path)
    return C.new_by_path(p.where("page_id % 3 <> 0"), p.where("page_id % 3 = 0")).select("page_id", "paper_path")


@query
def papers_union(spark, sf_dir):
    n = _names(spark, sf_dir)
    path = lambda x: F.concat(F.lit(x), F.col("page_id").cast("string")).alias("paper_path")
    first = n.where("page_id % 3 = 0").select("paper_name", path("a/"))
    second = n.where("page_id % 3 = 1").select("paper_name", (1990 + F.col("page_id") % 30).cast("string").alias("year"), F.lit("ACL").alias("conference_name"), H.venue_kind(F.col("url")).alias("workshop_or_main_conference"), path("b/"))
    year = H.url_year(F.col("url"))
    third = n.where("page_id % 3 = 2").select("paper_name", year.alias("year"), F.concat(F.lit("IJCAI "), year).alias("conference_name"), F.lit("main").alias("workshop_or_main"), path("c/"))
    return C.unite_papers(first, second, third)


@query
def listing_pages(spark, sf_dir):
    return C.listing_pages(_documents(spark, sf_dir).select("doc_id"), "doc_id", 100)


@query
def clean_text(spark, sf_dir):
    return B.clean_blocks(_documents(spark, sf_dir).select("doc_id", "text"))


@query
def merge_blocks(spark, sf_dir):
    return B.merge_blocks(V.blocks(spark, sf_dir))


@query
def block_union(spark, sf_dir):
    figures = _documents(spark, sf_dir).select("doc_id", F.lit(0).alias("page"), F.concat(F.lit("images/"), "lang", F.lit(".png")).alias("image_path"))
    return B.union_blocks(V.blocks(spark, sf_dir).select("doc_id", "page", "block_idx", "text"), figures)


@query
def top_blocks(spark, sf_dir):
    return B.top_blocks(V.blocks(spark, sf_dir)).select("doc_id", "page", "block_idx", "y0", "text")


@query
def md_lines(spark, sf_dir):
    return _lines(spark, sf_dir)


@query
def md_headers(spark, sf_dir):
    titles = [T.strip(F.regexp_extract("line", f"(?d){p}", 1)).alias(v) for v, p in (("v1", P.HEADER_V1), ("v2", P.HEADER_V2))]
    return _lines(spark, sf_dir).where(F.col("line").rlike(f"(?d){P.HEADER_V1}")).select("doc_id", "pos", *titles)


@query
def roman_headers(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "pos", S.roman_heading(F.col("line")).alias("title")).where("title IS NOT NULL")


@query
def special_headers(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "pos", S.special_heading(F.col("line")).alias("title")).where("title IS NOT NULL")


@query
def leading_roman(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "pos", T.leading_roman(F.col("line")).alias("roman")).where("roman <> ''")


@query
def watermark_filter(spark, sf_dir):
    return _lines(spark, sf_dir).where(M.is_watermark(F.col("line")))


def _sections(version: int) -> Query:
    def run(spark, sf_dir):
        found = S.output_sections(S.parse_sections(F.col(md), version), version)
        return V.markdown(spark, sf_dir).select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.*")

    return run


QUERIES["sections_v1"], QUERIES["sections_v2"] = _sections(1), _sections(2)


@query
def section_text(spark, sf_dir):
    return _sections(2)(spark, sf_dir).groupBy("doc_id", "title").agg(F.max(F.char_length("summary")).cast("long").alias("longest"))


@query
def section_citations(spark, sf_dir):
    return _sections(1)(spark, sf_dir).groupBy("doc_id").agg(F.sum("citation_count").alias("citations"), F.count(F.when(F.col("has_citation"), 1)).alias("cited_sections"))


@query
def paragraphs(spark, sf_dir):
    """Paragraphs numbered in their section, with their place in the document."""
    numbered = F.flatten(F.transform(S.parse_sections(F.col(md), 1), lambda s: F.transform(s["paragraphs"], lambda p, i: F.struct((i + 1).alias("paragraph_id"), p.alias("text")))))
    rows = V.markdown(spark, sf_dir).select("doc_id", F.posexplode(numbered).alias("at", "p")).select("doc_id", (F.col("at") + 1).cast("long").alias("place"), "p.*")
    found = M.citations(F.col("text"))
    return rows.select("doc_id", "place", "paragraph_id", "text", (F.size(found) > 0).alias("is_citation"), F.array_join(found, "|").alias("citations"))


@query
def citations(spark, sf_dir):
    found = M.citations(F.col(md))
    return V.markdown(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(found, "|").alias("found"))


def _references(version: int) -> Query:
    def run(spark, sf_dir):
        return V.markdown(spark, sf_dir).select("doc_id", F.explode(S.references(F.col(md), version)).alias("r")).select("doc_id", "r.*")

    return run


QUERIES["references_v1"], QUERIES["references_v2"] = _references(1), _references(2)


@query
def doc_ids(spark, sf_dir):
    d = _documents(spark, sf_dir).selectExpr("doc_id", f"{V.FILE_NAME} AS path")
    return d.select("doc_id", T.document_id(F.col("path"), F.lit(DAY)).alias("paper_id"), F.concat(T.stem(F.col("path")), F.lit("_processed.json")).alias("file"))


@query
def sanitize_names(spark, sf_dir):
    d = _documents(spark, sf_dir).selectExpr("doc_id", f"' ' || {V.FILE_NAME} || text AS name")
    return d.select("doc_id", F.concat(F.lit("papers/2020_"), T.sanitize(F.col("name")), F.lit(".pdf")).alias("trimmed"), T.sanitize(F.col("name"), trim=False).alias("untrimmed"))


@query
def sentences(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


QUERIES.update(similarity.queries())
QUERIES["corpus_stats"] = lambda spark, sf_dir: corpus_stats(V.markdown(spark, sf_dir))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in (ORACLE | similarity.ORACLE).items() if k in QUERIES}
