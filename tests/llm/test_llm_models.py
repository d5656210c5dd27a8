"""Language identification, language model scores, search and main texts."""

import collections
import math
import zlib

import numpy as np
import pytest
from llm_cases import no_docs, odd_docs, odd_rows, words

from reviewloom.llm import ball_tree, language, log_bilinear, page_diff, queries


def test_languages_of_documents(spark):
    got = queries.op5_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1000
    assert sum(r.language == r.declared for r in got) / len(got) > 0.99
    assert all(r.kept == (r.language != "und" and r.confidence >= language.CONFIDENCE) for r in got)


def test_languages_of_pages(spark):
    got = queries.page_languages(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 250 and sum(r.language == r.declared for r in got) / len(got) > 0.99


def test_text_outweighs_a_wrong_declaration(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from pyspark.sql import functions as F
    turned = docs.withColumn("lang", F.when(F.col("doc_id") % 10 == 0, "de").otherwise(F.col("lang")))
    found = language.document_languages(turned).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    assert found.where("language = truth").count() / found.count() > 0.95


def test_evidence_beside_the_text_decides_a_text_that_tells_nothing(spark):
    rows = [(k, "the and of that with this from have " * 3 if k % 2 else "der die und das mit nicht von ein " * 3,
             "en" if k % 2 else "de", "h.en.example" if k % 2 else "h.de.example", None) for k in range(80)]
    rows += [(100, "zq", None, "h.en.example", None), (101, "zq", None, "h.de.example", None)]
    got = {r.doc_id: r.language for r in language.document_languages(odd_docs(spark, rows)).collect()}
    assert got[100] == "en" and got[101] == "de"


def test_odd_documents_have_a_language_or_none(spark):
    docs = odd_docs(spark)
    got = language.document_languages(docs).collect()
    assert len(got) == len(odd_rows())
    assert all(r.language == "und" and not r.kept for r in got if r.doc_id in (4, 5, 6, 11))
    kept = language.accepted_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert language.document_languages(no_docs(spark)).count() == 0
    assert language.accepted_documents(no_docs(spark)).count() == 0


def test_many_languages_have_profiles_and_rare_ones_are_kept(spark):
    rng = np.random.default_rng(4)
    tags = [f"{a}{b}" for a in "pq" for b in "abcdefghijklmnopqrst"]
    syllables = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 4)) for _ in range(12 * 42)]

    def text(k):
        return " ".join("".join(rng.choice(syllables[12 * k:12 * k + 12], 2)) for _ in range(40))
    rows = [(n, text(n % 40), tags[n % 40], None, None) for n in range(400)]
    rows += [(1000 + n, text(40), "zz", None, None) for n in range(language.LEAST_ROWS - 1)] + [(2000, "0 1", "yy", None, None)]
    docs = odd_docs(spark, rows)
    got = {r.doc_id: r for r in language.document_languages(docs).collect()}
    assert all(got[n].language == tags[n % 40] and got[n].kept for n in range(400))
    assert all(got[n].language == "zz" and got[n].kept for n in range(1000, 1000 + language.LEAST_ROWS - 1))
    assert got[2000].language == "und" and not got[2000].kept
    assert language.accepted_documents(docs).count() == len(rows) - 1


def test_address_parts(spark):
    from pyspark.sql import functions as F
    urls = ["https://www.Example.co.de:80/fr/1?x", "http://u@h.org", None, "no address", "//a.fr/es"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [tuple(r) for r in frame.select(language.host_of(F.col("url")), language.suffix_of(F.col("url"))).collect()]
    assert got == [("example.co.de", "de/fr"), ("h.org", "org/"), (None, None), (None, None), ("a.fr", "fr/es")]
    tags = spark.createDataFrame([("<HTML class=x LANG='pt-BR'>",), ("<html>",), (None,)], "h string")
    assert [r[0] for r in tags.select(language.html_language(F.col("h"))).collect()] == ["pt", None, None]


def base_scores(rows):
    tokens = [[w.lower() for w in words(t)] + [None] for _, t, *_ in rows]
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 == 0 for r in rows]
    counts = collections.Counter(w for own, h in zip(tokens, held) if not h for w in own)
    n, v = sum(counts.values()), len(counts)
    return sorted(((r[0], h, len(own), sum(counts[w] > 0 for w in own), n,
                    round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), 4))
                   for r, h, own in zip(rows, held, tokens)), key=repr)


def test_base_scores(spark):
    got = log_bilinear.score(odd_docs(spark)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got),
                  key=repr) == base_scores(odd_rows())
    assert log_bilinear.score(no_docs(spark)).count() == 0


def test_words_beyond_the_known_are_joined(spark, monkeypatch):
    monkeypatch.setattr(log_bilinear, "KNOWN", 20)
    monkeypatch.setattr(log_bilinear, "OUTPUTS", 5)
    got = log_bilinear.score(odd_docs(spark)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got),
                  key=repr) == base_scores(odd_rows())


def test_the_model_beats_the_base_on_held_out_texts(spark):
    got = [r for r in queries.op3_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert sum(r.score > r.base_score for r in got) > 0.9 * len(got)


def test_probabilities_add_up_to_one(spark):
    """After the same beginning, the known words, one unseen word and the end share the whole probability."""
    vocabulary = ["a", "b", "c", "d", "e", "f"]
    rows = [(k, " ".join(vocabulary[:1 + k % 6]), None, None, None) for k in range(60)]
    held = [n for n in range(10**4, 10**5) if zlib.crc32(str(n).encode()) % 10 == 0]
    begun = [(held[k], f"a {w}".strip(), None, None, None) for k, w in enumerate([*vocabulary, "unseen"])]
    docs = odd_docs(spark, rows + begun)
    _, vocabulary_found = log_bilinear.count_words(log_bilinear._rows(docs, "doc_id", "text"))
    model = log_bilinear._fresh(vocabulary_found)
    import pyarrow as pa
    texts = ["a", *(t for _, t, *_ in begun)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([True] * len(texts))],
                                       ["doc_id", "text", "held_out"])
    targets, place, begin, *_ = log_bilinear._sequence(batch, vocabulary_found)
    logs = {}
    for k, at in enumerate(begin):
        near = log_bilinear._contexts(targets, place, np.array([at + 1]), len(vocabulary_found.own))
        predicted = sum(model["context"][near[j]] * model["places"][j] for j in range(log_bilinear.CONTEXT))
        scores = (predicted @ model["target"].T + model["bias"])[0]
        logs[texts[k]] = scores[targets[at + 1]] - np.log(np.exp(scores).sum())
    assert sum(np.exp(x) for x in logs.values()) == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("scale", [1, 300])
def test_scores_are_normalised_for_small_and_large_parameters(scale):
    """Scores far outside the range of exp are shifted first, others are not; both are proper logarithms."""
    rng, size = np.random.default_rng(2), 60
    vocabulary = log_bilinear.Vocabulary(np.arange(size), np.ones(size), np.arange(size), 100, size, 3, np.ones(size + 2))
    p = {k: scale * rng.normal(size=v.shape).astype(np.float32) for k, v in log_bilinear._fresh(vocabulary).items()}
    targets = np.append(rng.integers(0, size, 50), vocabulary.end)
    got = log_bilinear._log_probabilities(targets, np.arange(51), p, vocabulary)
    kinds = vocabulary.classes

    def log_share(scores, mine):
        return scores[mine] - scores.max() - np.log(np.exp(scores - scores.max()).sum())
    for at, target in enumerate(targets):
        near = log_bilinear._contexts(targets, np.arange(51), np.array([at]), size + 2)[:, 0]
        predicted = (p["context"][near].astype(float) * p["places"]).sum(axis=0)
        want = log_share(p["class"] @ predicted + p["class_bias"], kinds[target])
        of = np.flatnonzero(kinds == kinds[target])
        want += log_share(p["target"][of] @ predicted + p["bias"][of], int((of < target).sum()))
        assert got[at] == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_rare_words_have_models_of_their_own(spark):
    """Words far down the list are told apart by their contexts, and classes and words add up to one."""
    rng = np.random.default_rng(5)
    train, held = ([n for n in range(10**4, 10**5) if (zlib.crc32(str(n).encode()) % 10 == 0) == h] for h in (False, True))
    pairs = [f"left{k % 20} right{k % 20}" for k in range(800)]
    rows = [(train[k], " ".join(f"often{n}" for n in rng.integers(0, 400, 60)) + " " + pairs[k % 800], None, None, None)
            for k in range(1600)]
    asked = [(held[20 * a + b], f"left{a} right{b}", None, None, None) for a in range(20) for b in range(20)]
    docs = odd_docs(spark, rows + asked)
    got = {r.doc_id: r for r in log_bilinear.score(docs).collect()}
    model = np.array([[got[held[20 * a + b]].score for b in range(20)] for a in range(20)])
    base = np.array([[got[held[20 * a + b]].base_score for b in range(20)] for a in range(20)])
    assert np.ptp(base) < 1e-9 and (np.diag(model) > model.mean(axis=1)).mean() > 0.9

    rows_ = log_bilinear._rows(docs, "doc_id", "text")
    _, vocabulary = log_bilinear.count_words(rows_)
    size = len(vocabulary.own)
    assert size == 442  # 440 words, all others, the end
    p = log_bilinear.train(rows_, vocabulary)
    targets, place = np.stack([np.full(size, 430), np.arange(size)], axis=1).ravel(), np.tile([0, 1], size)
    logs = log_bilinear._log_probabilities(targets, place, p, vocabulary)
    assert np.exp(logs[1::2]).sum() == pytest.approx(1, abs=1e-4) and np.ptp(logs[::2]) < 1e-4


def test_every_place_is_learnt_beyond_the_first_rows(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = log_bilinear._rows(docs, "doc_id", "text")
    _, vocabulary = log_bilinear.count_words(rows)
    table = rows.where("NOT held_out").toArrow()
    trainer = log_bilinear.Trainer(log_bilinear._fresh(vocabulary), vocabulary, 1)
    trainer.learn_from(iter(table.to_batches()), vocabulary)
    assert trainer.places == vocabulary.tokens
    monkeypatch.setattr(log_bilinear, "FIRST_ROWS", 50)
    got = log_bilinear.score(docs).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def brute_top(rows, is_query, k, scale=1024):
    usable = [(n, np.floor(scale * np.array(v, np.float64)).astype(np.int64)) for n, v in rows
              if n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(n, v.tobytes()): (n, v) for n, v in usable if is_query(n)}.values():
        found = sorted((-int(a @ b), n) for n, b in usable if n != q and len(a) == len(b))[:k]
        out += [(q, rank + 1, n, -s) for rank, (s, n) in enumerate(found)]
    return sorted(out)


def test_search(spark, monkeypatch):
    monkeypatch.setattr(ball_tree, "LEAF", 4)
    monkeypatch.setattr(ball_tree, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(size=6)]) for k in range(3000)]
    rows += [(3000 + k, rows[40][1]) for k in range(200)]
    rows += [(None, rows[0][1]), (4000, None), (4100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (4200, [float("nan")] * 6),
             (4300, [float("inf")] + [0.0] * 5), (4400, [1.0, 2.0]), (4401, [2.0, -1.0]), (4500, []), (100, rows[100][1])]
    frame = spark.createDataFrame([(n, v, 1, 2, 3) for n, v in rows],
                                  "vec_id long, embedding array<float>, shard int, block int, least int")
    from pyspark.sql import functions as F
    got = ball_tree.top_k(frame, F.col("vec_id") % 100 == 0, k=10).collect()
    stored = [(n, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for n, v in rows]
    assert sorted(tuple(r) for r in got) == brute_top(stored, lambda n: n % 100 == 0, 10)
    assert ball_tree.top_k(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("shard", [16, 100])
def test_search_leaves_out_cells_and_cuts_large_ones(spark, monkeypatch, shard):
    """Clustered vectors: many cells, one of them with most rows, and queries that reach few of them."""
    monkeypatch.setattr(ball_tree, "SHARD", shard)
    asked, reached = [], ball_tree._reached

    def counted(centres, radii, slices, others, scale):
        asked.append(int(slices.sum()))
        return reached(centres, radii, slices, others, scale)
    monkeypatch.setattr(ball_tree, "_reached", counted)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 8)) * 4
    at = np.where(rng.random(1500) < 0.4, 0, rng.integers(0, 30, 1500))
    rows = [(k, [float(x) for x in centres[c] + rng.normal(0, 0.05, 8)]) for k, c in enumerate(at)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F
    got = ball_tree.top_k(frame, F.col("vec_id") % 50 == 0, k=5).collect()
    stored = [(n, [float(np.float32(x)) for x in v]) for n, v in rows]
    assert sorted(tuple(r) for r in got) == brute_top(stored, lambda n: n % 50 == 0, 5)
    assert asked[0] > 1500 // shard


def test_search_for_a_row_repeated_more_than_k_times(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.normal(size=4)]) for k in range(300)]
    rows += [(0, rows[0][1])] * 30 + [(5, rows[0][1])] * 14 + [(200, rows[0][1])] * 30 + [(k, rows[0][1]) for k in range(400, 420)]
    rows += [(100, [float(x) for x in rng.normal(size=4)]) for _ in range(20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F
    got = ball_tree.top_k(frame, F.col("vec_id") % 100 == 0, k=10).collect()
    stored = [(n, [float(np.float32(x)) for x in v]) for n, v in rows]
    assert sorted(tuple(r) for r in got) == brute_top(stored, lambda n: n % 100 == 0, 10)


def test_bounds_hold_for_every_node():
    rng = np.random.default_rng(8)
    points = np.floor(1024 * rng.normal(size=(500, 8)))
    tree, asked = ball_tree.BallTree(points), np.floor(1024 * rng.normal(size=(20, 8)))
    lengths = np.sqrt((asked**2).sum(axis=1))
    for node in range(len(tree.radii)):
        inside = points[tree.order[tree.first[node]:tree.last[node]]]
        high = tree.bounds(asked, lengths, np.full(20, node))
        assert ((asked @ inside.T).max(axis=1) <= high).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="no-sidebar">
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<header><h2>Site</h2></header><aside>Side</aside><!-- note --><form><p>Name</p></form>
<article><h1>Title &amp; more</h1><p>First&nbsp;line<br>goes   on <b>bold</b>.<p>Second &lt;b&gt;<div class="advert">Buy</div>
<script>var x = "</p><p>no";</script><ul><li>One</li><li><a href="#">two</a> and text</li></ul>
<section id="comments"><p>Nice!</p></section></article><div class="comments"><p>First!</p></div><footer>End</footer></body>"""


def test_page_lines():
    assert [text for text, _ in page_diff.page_lines(PAGE)] == [
        "Title & more", "First line goes on bold .".replace(" .", "."), "Second <b>", "One", "two and text"]
    header = "<article><header><h1>Headline</h1><p>By <a href=x>me</a></p><h2>Sub</h2></header><p>Body</p></article>"
    assert [text for text, _ in page_diff.page_lines(header)] == ["Headline", "Sub", "Body"]
    assert page_diff.page_lines("") == [] and page_diff.page_lines("plain text") == [("plain text", True)]
    assert page_diff.page_lines("<p>a < b & c<p>x<unclosed 'q") == [("a < b & c", True), ("x<unclosed 'q", True)]
    assert [t for t, _ in page_diff.page_lines("<div class='sidebar-left'><article><p>In a frame</p></article></div>")] == ["In a frame"]


def test_an_article_decides_only_if_it_holds_the_text():
    card = "<div><p>The whole long text of the page.</p></div><article><p>Read on</p></article>"
    assert page_diff.page_lines(card) == [("The whole long text of the page.", True), ("Read on", True)]
    beside = "<article><p>The whole long text of the page.</p></article><p>By me</p>"
    assert page_diff.page_lines(beside) == [("The whole long text of the page.", False), ("By me", True)]
    for comment in ("<article class='comment'>{}</article>", "<div id=comments><article>{}</article></div>"):
        page = "<article><p>The text.</p>{0}</article>{0}".format(comment.format("<p>First! I have a lot to say on it.</p>"))
        assert page_diff.page_lines(page) == [("The text.", False)]
        assert page_diff.page_lines(comment.format("First!") + "<p>The text.</p>") == [("The text.", True)]
    for frame in ("<main class='has-sidebar'>{}</main>", "<div class='menu-open'><article>{}</article></div>"):
        assert page_diff.page_lines(frame.format("<p>The text.</p>") + "<p>Site</p>") == [("The text.", False), ("Site", True)]


def test_lines_outside_an_article_are_compared(spark):
    page = "<p>Our site</p><article><p>A long text that number {0} tells alone.</p><p>Told by all</p></article><p>Posted on day {0}</p>"
    teaser = "<div><p>A long text that number {0} tells alone.</p></div><article><p>Join us</p></article>"
    rows = [(k, f"http://{h}.example/{k}", html.format(k)) for k, (h, html) in enumerate([("a", page)] * 3 + [("b", teaser)] * 3)]
    got = {r.page_id: r.text for r in page_diff.main_texts(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(3):
        assert got[k] == f"A long text that number {k} tells alone.\n\nTold by all\n\nPosted on day {k}"
        assert got[k + 3] == f"A long text that number {k + 3} tells alone."


def test_raw_elements_take_no_text_that_is_not_theirs():
    def texts(page):
        return [text for text, _ in page_diff.page_lines(page)]

    for empty in ("<svg/>", "<svg width='1' />", "<iframe src='x' />", "<canvas id=c />", "<script src='x'/>", "<math/>",
                  "<object data='x'/>", "<iframe src=x>", "<svg>", "<canvas>"):
        assert texts(f"<article>{empty}<p>One</p><p>Two</p></article>") == ["One", "Two"], empty
        if empty.endswith("/>"):
            assert texts(f"<article>{empty}<p>One</p><svg>no</svg><p>Two</p></article>") == ["One", "Two"], empty
    assert texts("<p>One</p><script src=/a/>no()</script><svg><text>no</text></svg><p>Two</p><style>no") == ["One", "Two"]
    assert texts("<p>So <math><mi>a</mi><mo>=</mo><mn>1</mn></math>.</p><object data=x><p>Instead</p></object>") == ["So a=1.", "Instead"]


def texts_of(page):
    return [text for text, _ in page_diff.page_lines(page)]


@pytest.mark.parametrize("page", [
    "<body><form action=/post><p>Menu</p>{}<input name=q></form></body>",
    "<form><fieldset><label>{}</label></fieldset></form>",
    "<body><nav><ul><li><a href=/>Home</a></li></ul>{}<footer>End</footer></body>",
    "<header><h2>Site</h2><div>{}</div>",
    "<div class='menu wrapper'>{}</div>",
])
def test_an_article_is_not_lost_with_what_stands_around_it(page):
    article = "<article><h1>Title</h1><p>The whole long text of the article, said once.</p></article>"
    assert texts_of(page.format(article)) == ["Title", "The whole long text of the article, said once."]


@pytest.mark.parametrize("start", [
    "<article class='post tag-social'>", "<article class='hentry category-search-engines'>", "<div class='notice-of-meeting'>",
    "<article><div class='related-work'>", "<div id=search-for-meaning>", "<section class='history-of-advertising'>"])
def test_a_name_that_only_holds_a_telling_word_drops_nothing(start):
    assert texts_of(f"{start}<p>The text.</p>") == ["The text."]


@pytest.mark.parametrize("name", ["ad", "ads", "ad-container", "ad_slot_1", "cookie-notice", "site-footer", "related-posts", "post-comments", "sidebar-left",
                                  "social-share-buttons", "main-menu", "big comments"])
def test_names_with_their_usual_partners_drop_an_element(name):
    assert texts_of(f"<p>The text of the page.</p><div class='{name}'><p>Other</p></div>") == ["The text of the page."]


def test_a_form_around_a_page_without_an_article_is_compared():
    page = "<p>Skip</p><form id=aspnet><div><p>The long text of a page in a form.</p><p>More of it.</p><nav>Menu</nav></div></form><p>End</p>"
    assert page_diff.page_lines(page) == [("Skip", True), ("The long text of a page in a form.", True), ("More of it.", True), ("End", True)]
    assert page_diff.page_lines("<p>A text that is longer than the form.</p><form><p>Your name</p></form>") == [
        ("A text that is longer than the form.", True)]
    assert page_diff.page_lines("<div class=sidebar><p>All there is.</p></div>") == [("All there is.", True)]
    assert page_diff.page_lines("<nav>Menu</nav><div class=comments>First!</div><script>x</script>") == []


def test_the_head_ends_where_the_page_begins():
    assert texts_of("<head><title>T</title><meta x=1><p>One</p><div>Two</div>") == ["One", "Two"]
    assert texts_of("<html><head><title>T</title><body><p>One</p>") == ["One"]


@pytest.mark.parametrize("part", ["<iframe>", "<div></p>", "<p><b></i>", "<a ", "<", "<nav>", "<form><label>", "<!-- ", "</div>", '<a b="', "<svg>", "x<br>"])
def test_time_follows_the_length_of_a_page(part):
    import time

    def seconds(count):
        begin = time.perf_counter()
        page_diff.page_lines(part * count)
        return time.perf_counter() - begin
    seconds(1000)
    assert seconds(64_000) < 40 * seconds(4_000) + 0.5


def test_a_very_long_page():
    lines = [f"Line {k} of the text." for k in range(50_000)]
    page = "<nav>Menu</nav><article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article><footer>End</footer>"
    assert texts_of(page) == lines


def test_pages_of_the_table(spark):
    """The article element of each generated page holds its main text."""
    import html
    import re
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = queries.op8_html_extraction(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        inner = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        lines = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(x for x in lines if x) and r.n_chars == len(r.text)


def test_differencing(spark):
    site = "<div>Site</div><div><a href='/'>Home</a></div><p>Text of page {0}.</p><p>Both {1}</p><p>All rights reserved</p>"
    rows = [(k, f"http://h.example/a/{k}", site.format(k, k // 2)) for k in range(6)]
    rows += [(10, "http://copy.example/1", "<p>Same</p>"), (11, "http://copy.example/2", "<p>Same</p>"),
             (12, "http://alone.example/x", "<p>Alone</p>"), (13, None, None), (None, "", ""), (14, "http://h.example/a/3", "")]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, row int, part int")
    got = {r.page_id: r.text for r in page_diff.main_texts(frame).collect()}
    assert got[0] == "Text of page 0." and got[2] == "Text of page 2.\n\nBoth 1"[:len(got[2])]
    assert got[10] == got[11] == "Same" and got[12] == "Alone" and got[13] == "" and got[None] == ""
    assert page_diff.main_texts(frame.limit(0)).count() == 0


def test_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(0, 14)), rng.integers(0, 5, rng.integers(0, 14))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        shared = page_diff.common(a, b)
        rest = iter(b.tolist())
        assert shared.sum() == table[-1][-1] and all(x in rest for x in a[shared].tolist())
