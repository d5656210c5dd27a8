from html.parser import HTMLParser

from reviewloom.operators.cleaning import distinct_contents, distinct_reviews
from reviewloom.operators.extract import PAGE_RULES, SITE_RULES, extract_items, extract_reviews, read_page
from pyspark.sql import functions as F
from reviewloom.schemas import PAGES

STAR, OFF = '<span class="figure_star on"></span>', '<span class="figure_star"></span>'
FIRST = f"""<ul class="list_review wide">
<li>{STAR * 5}<span class="txt_date"> 2024.05.03. </span><p class="desc_review">A &amp; B <b>bold</b><br>next</p></li>
<li>{OFF}<span class="txt_date">2024.05.04.</span><p class="x desc_review">zero stars</p></li>
<li>{STAR}<p class="desc_review">no date</p></li>
<li>{STAR}<span class="txt_date">2024.05.05.</span></li>
<li>{STAR * 5}<span class="txt_date"> 2024.05.03. </span><p class="desc_review">A &amp; B <b>bold</b><br>next</p></li>
<li><ul><li>{STAR}<span class="txt_date">d</span><p class="desc_review">nested list</p></li></ul></li>
</ul><ul class="other"><li>{STAR}<span class="txt_date">d</span><p class="desc_review">other list</p></li></ul>"""

SVG_ON, SVG_OFF = '<svg><path fill="#51ABF3"></path></svg>', '<svg><path fill="#DDD"/><path fill="#51ABF3"/></svg>'
RATED = '<div class="starRating starRating--m starRating--blue starRating--">%s</div>'
SECOND = f"""<div class="offer-review__list--content">{RATED % (SVG_ON * 3 + SVG_OFF)}
<div class="offer-review__list--purpose"><b>family</b> <i> 2024.05.03 </i></div>
<div class="offer-review__list--wrapper"><div class="offer-review__list--message"><div class="with-more"> one <br> two<script>x</script></div></div></div></div>
<div class="offer-review__list--content"><div class="offer-review__list--purpose"></div>
<div class="offer-review__list--photo-wrapper"><div class="offer-review__list--message"><div class="with-more">photo text</div></div></div></div>
<div class="offer-review__list--content">{RATED % SVG_ON}<div class="offer-review__list--purpose">2024.05.04</div>
<div class="offer-review__list--wrapper"></div><div class="offer-review__list--photo-wrapper"><div class="offer-review__list--message"><div class="with-more">not read</div></div></div></div>"""

CARD = ('<div class="TripReviewItemContainer-sc-1fopyhi-0 a review-item"><span class="review_score"> 5 </span>'
        '<p class="hover-pointer">%s</p><span class="r c2 create-time">%s</span></div>')
THIRD = CARD % ("fine", "작성일: 2024년 5월 3일") + CARD % ("odd", "작성일: x") + CARD.replace("review_score", "score") % ("skipped", "d")


def pages(spark, *htmls):
    return spark.createDataFrame([(i, "u", h) for i, h in enumerate(htmls)], PAGES)


def items(df):
    return [(r.rating, r.date, r.content) for r in df.orderBy("page_id", "item_no").collect()]


def test_first_site(spark):
    got = extract_reviews(pages(spark, FIRST, "<p>nothing</p>"), "kakaomap")
    twice = (5.0, "2024.05.03.", "A & B boldnext")
    # the last item holds a list of its own, so it is read through its descendants
    assert items(got) == [twice, (0.0, "2024.05.04.", "zero stars"), twice, (1.0, "d", "nested list")]
    assert distinct_reviews(got.withColumn("ingest_seq", F.col("item_no"))).count() == 3


def test_second_site(spark):
    assert items(extract_reviews(pages(spark, SECOND), "myrealtrip")) == [
        (3.0, "2024.05.03", "one\ntwo"), (0.0, "", "photo text"), (1.0, "2024.05.04", "")]


def test_third_site_keeps_the_first_of_a_text_across_tabs(spark):
    tabs = pages(spark, THIRD, THIRD).withColumn("filter_index", F.lit(1) - F.col("page_id"))
    got = extract_reviews(tabs, "tripdotcom", ("page_id", "filter_index"))
    assert items(got)[:2] == [(5.0, "2024.05.03", "fine"), (5.0, "작성일: x", "odd")] and got.count() == 4
    first = distinct_contents(got.withColumn("ingest_seq", F.col("page_id") * 1000 + F.col("item_no")))
    assert {(r.page_id, r.content) for r in first.collect()} == {(1, "fine"), (1, "odd")}


def test_page_fields(spark):
    html = "<html><head><title>T &lt;1&gt;</title></head><body><a href=x>1</a><article><h1> Head </h1><p>a<p>b</p></article></body></html>"
    row = extract_items(pages(spark, html), PAGE_RULES).first()
    assert (row.title, row.headline, row.paragraphs, row.links) == ("T <1>", "Head", "2", "1")


def test_broken_markup_and_depth():
    rules = SITE_RULES["kakaomap"]
    assert read_page("</div><ul class=list_review><li", rules) == []
    deep = "<div>" * 5000 + '<ul class="list_review"><li><span class="txt_date">d</span><p class="desc_review">t'
    assert read_page(deep, rules) == [{"rating": "0", "date": "d", "content": "t"}]


def test_a_start_tag_is_taken_apart_once(monkeypatch):
    """Tags that repeat are known by their text; odd ones are still read by the parser's own rules."""
    calls, own = [], HTMLParser.parse_starttag
    monkeypatch.setattr(HTMLParser, "parse_starttag", lambda self, i: calls.append(i) or own(self, i))
    item = f'<li>{STAR * 3}{OFF}<span class="txt_date">d</span><p class="desc_review">a > b</p></li>'
    odd = "<LI><span class='figure_star on' x>*</span><span\nclass=txt_date>e</span><P class=\"a>b desc_review\" >c</P></LI>"
    found = read_page(f'<ul class="list_review">{item * 200}{odd}</ul>', SITE_RULES["kakaomap"])
    assert found == [{"rating": "3", "date": "d", "content": "a > b"}] * 200 + [{"rating": "1", "date": "e", "content": "c"}]
    assert len(calls) < 20
