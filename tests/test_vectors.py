import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.fixed_values import NOTE_HIGH, NOTE_LOW, REPLY_BLANK_QUESTION, REPLY_NO_REVIEWS
from reviewloom.functions.labels import chunk_source, confidence, confidence_note, hit_source, reference_line
from reviewloom.functions.vectors import inner_product, l2_normalise
from reviewloom.operators import cells, knn, retrieval
from reviewloom.operators.embed import embed, hashed_features, unit_rows
from reviewloom.operators.ordered import number_rows
from reviewloom.schemas import INDEX, INDEX_META
from reviewloom.sources import tables

VECTORS = "vec_id long, embedding array<float>"
QUERIES = "query_id long, embedding array<float>"


def random_tables(spark, n, q, dim=3, levels=3, seed=0):
    """Small whole-number vectors, so that many scores tie."""
    rng = np.random.default_rng(seed)
    v = rng.integers(-levels, levels + 1, (n, dim)).astype(float)
    w = rng.integers(-levels, levels + 1, (q, dim)).astype(float)
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], VECTORS)
    queries = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(w)], QUERIES)
    return v, w, vectors, queries


def brute(v, w, k, skip_self=False):
    out = {}
    for i, query in enumerate(w):
        scored = sorted((-round(float(query @ x), 6), j) for j, x in enumerate(v) if not (skip_self and i == j))
        out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("n, k, parts", [(200, 5, 1), (200, 5, 7), (3, 10, 2), (50, 50, 3)])
@pytest.mark.parametrize("skip_self", [False, True])
@pytest.mark.parametrize("broadcast_bytes", [knn.QUERY_BYTES, 0])
def test_nearest_equals_brute_force(spark, n, k, parts, skip_self, broadcast_bytes):
    v, w, vectors, queries = random_tables(spark, n, 20)
    got = knn.nearest(vectors.repartition(parts), queries, k, skip_self, broadcast_bytes)
    assert found(got) == brute(v, w, k, skip_self)


def clustered(spark, n=600, asked=40, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, 8)) * 5
    v = centres[rng.integers(0, 12, n)] + rng.normal(0, 0.1, (n, 8))
    w = centres[rng.integers(0, 12, asked)] + rng.normal(0, 0.1, (asked, 8))
    rows = [spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(t)], f"{name} long, embedding array<double>")
            for name, t in (("vec_id", v), ("query_id", w))]
    return v, w, *rows


@pytest.mark.parametrize("cell_rows, ask_rows", [(20, 7), (1000, 3), (3, 1000)])
def test_cells_leave_out_pairs_and_no_hit(spark, monkeypatch, cell_rows, ask_rows):
    v, w, vectors, queries = clustered(spark)
    divided = cells.divide(vectors, 8, cell_rows)
    assert divided.rows.sum() == len(v) and len(divided.rows) == -(-len(v) // cell_rows)
    got = knn.search_cells(divided, queries, 4, ask_rows)
    assert found(got.hits) == brute(v, w, 4)
    assert got.possible == len(v) * len(w)
    assert got.scored < 0.5 * got.possible if cell_rows < 1000 else got.scored == got.possible


def test_bounds_are_not_below_any_product(spark):
    v, w, vectors, _ = clustered(spark, 200, 30)
    divided = cells.divide(vectors, 8, 15)
    bound = divided.bounds(w)
    for row in divided.points.collect():
        assert (bound[:, row.cell] >= w @ v[row.vec_id]).all()


def test_stored_cells_are_read_back(spark, tmp_path):
    v, w, vectors, queries = clustered(spark)
    cells.write(vectors, 8, str(tmp_path / "index"), 30)
    assert found(knn.search_cells(cells.load(spark, str(tmp_path / "index")), queries, 3).hits) == brute(v, w, 3)


def test_large_cells_are_searched_in_slices(spark, monkeypatch):
    monkeypatch.setattr(knn, "VECTOR_TILE", 50)
    v, w, vectors, queries = clustered(spark)
    assert found(knn.search_cells(cells.divide(vectors, 8, 300), queries, 5, 10).hits) == brute(v, w, 5)


@pytest.mark.parametrize("part_rows, rounds", [(4096, 4), (50, 16), (7, 2)])
def test_queries_travel_once_a_round_to_a_part_of_cells(spark, monkeypatch, part_rows, rounds):
    """What is sent are queries by parts of neighbouring cells, not by cells."""
    sent, write = [], knn.stored

    def kept(df, purpose):
        out = write(df, purpose)
        if purpose == "asks":
            sent.append(out.groupBy("query_id", "part").count())
        return out

    monkeypatch.setattr(knn, "stored", kept)
    monkeypatch.setattr(knn, "STEP", rounds)
    monkeypatch.setattr(knn, "PART_BYTES", 8 * 8 * part_rows)
    monkeypatch.setattr(knn, "ASK_BYTES", 8 * 8 * 10)
    monkeypatch.setattr(knn, "OUT_ROWS", 9)
    v, w, vectors, queries = clustered(spark)
    divided = cells.divide(vectors, 8, 10)
    got = knn.search_cells(divided, queries, 5)
    assert found(got.hits) == brute(v, w, 5) and got.scored <= got.possible
    assert all(r["count"] == 1 for part in sent for r in part.collect())
    assert len(knn._parts(divided, 4096).first) == 1 and len(knn._parts(divided, 50).first) > 3


@pytest.mark.parametrize("broadcast_bytes", [knn.QUERY_BYTES, 0])
def test_bad_vectors_and_other_lengths_change_no_hit(spark, broadcast_bytes):
    """NaN, infinity and vectors of a second length, among vectors and queries."""
    rng = np.random.default_rng(8)
    short, long = rng.normal(0, 1, (30, 2)), rng.normal(0, 1, (25, 4))
    rows = [(i, x.tolist()) for i, x in enumerate(short)] + [(100 + i, x.tolist()) for i, x in enumerate(long)]
    bad = [(200, [float("nan"), 1.0]), (201, [float("inf"), 1.0]), (202, [1.0, float("-inf")]), (203, [None, 1.0]), (204, None), (205, [])]
    vectors = spark.createDataFrame(rows + bad + [(206, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame(rows[:5] + rows[30:36] + bad, "query_id long, embedding array<double>")
    want = {i: [(j, s) for j, s in brute(short, short[i:i + 1], 3)[0]] for i in range(5)}
    want |= {100 + i: [(100 + j, s) for j, s in brute(long, long[i:i + 1], 3)[0]] for i in range(6)}
    assert found(knn.nearest(vectors, queries, 3, broadcast_bytes=broadcast_bytes)) == want
    assert knn.unusable(vectors).first()[0] == 6 and knn.unusable(vectors, queries).first()[0] == 7


def test_tiles_and_zero_vectors(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_TILE", 4)
    monkeypatch.setattr(knn, "VECTOR_TILE", 5)
    rng = np.random.default_rng(1)
    v, w = rng.integers(-2, 3, (40, 3)).astype(float), rng.integers(-2, 3, (9, 3)).astype(float)
    w[0] = 0
    best = knn._TopK(np.arange(9), w, 6)
    for at in range(0, 40, 13):
        best.add(np.arange(at, min(at + 13, 40)), v[at:at + 13])
    got = {}
    hits = best.hits().to_pandas().sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    for r in hits.itertuples():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(v, w, 6)


def test_no_queries_and_no_vectors(spark):
    _, _, vectors, queries = random_tables(spark, 5, 2)
    assert knn.nearest(vectors, queries.filter("false")).count() == 0
    assert knn.nearest(vectors.filter("false"), queries).count() == 0


SCORES = [([.9, .8, .7, .6, .5, .45], 5, 6), ([.9, .5, .4, .3], 3, 3), ([.9, .3, .2, .1], 3, 3), ([.3, .2, .1], 3, 3),
          ([.9, .3], 1, 1), ([.3, .2], 1, 1), ([.9, .8], 2, 2)]


def test_threshold_floor_and_cap(spark):
    hits = spark.createDataFrame(
        [(q, i, s, i + 1) for q, (scores, _, _) in enumerate(SCORES) for i, s in enumerate(scores)],
        "query_id long, vec_id long, score double, rank int")
    got = {r.query_id: r for r in retrieval.quality(retrieval.select_hits(hits)).collect()}
    assert {q: (r.used_count, r.filtered_count, r.total_found) for q, r in got.items()} == {
        q: (used, kept, len(scores)) for q, (scores, used, kept) in enumerate(SCORES)}
    assert retrieval.threshold(hits).count() == sum(s >= .6 for scores, _, _ in SCORES for s in scores)


def test_confidence_edges(spark):
    rows = spark.createDataFrame([(.49,), (.5,), (.7,), (.71,)], "s double").select(
        confidence(F.col("s")).alias("c")).withColumn("n", confidence_note(F.col("c")))
    assert [tuple(r) for r in rows.collect()] == [("low", NOTE_LOW), ("none", ""), ("none", ""), ("high", NOTE_HIGH)]


def test_normalise_and_product(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>").select(
        l2_normalise(F.col("a")).alias("a"), l2_normalise(F.col("z")).alias("z"),
        inner_product(F.col("a"), F.col("a")).alias("p")).first()
    assert np.allclose(row.a, [.6, .8]) and row.z == [0.0, 0.0] and row.p == 25.0


def test_embedding_does_not_depend_on_partitions_and_loads_once_per_task(spark):
    rows = spark.createDataFrame([(i, f"word{i % 5} other") for i in range(50)] + [(50, None)], "i int, t string")
    one = {r.i: r.embedding for r in embed(rows.coalesce(1), "t").collect()}
    many = {r.i: r.embedding for r in embed(rows.repartition(7), "t").collect()}
    assert one == many and one[50] == [0.0] * 64
    assert np.allclose(unit_rows(hashed_features(["word0 other"]))[0], one[0])
    assert abs(sum(x * x for x in one[1]) - 1) < 1e-6


def meta_rows(spark):
    return spark.createDataFrame(
        [(0, ("trip", "s", "p", "2024", 5.0, "")), (1, (None, None, "p", None, None, None)), (2, ("unknown", "", "", "", 1.5, ""))],
        "i int, meta struct<platform:string,subject:string,place:string,date:string,rating:double,url:string>").orderBy("i")


def test_source_strings(spark):
    assert [r[0] for r in meta_rows(spark).select(hit_source(F.col("meta"))).collect()] == [
        "review|2024|rating=5.0|trip", "review|", "review||rating=1.5"]
    assert [r[0] for r in meta_rows(spark).select(chunk_source(F.col("meta"))).collect()] == [
        "trip|s|2024|rating=5.0", "review|p|", "unknown|||rating=1.5"]
    assert meta_rows(spark).select(reference_line(F.lit(" a\n" + "b" * 50), F.col("meta"))).first()[0] == (
        '   - "a ' + "b" * 38 + '..." (플랫폼: trip, 평점: 5.0, 날짜: 2024)')


def index(spark):
    meta = ("kakaomap", "s", "p", "2024-05-03", 5.0, "")
    return spark.createDataFrame(
        [(0, "good park", meta, [1.0, 0.0]), (1, " good park ", meta, [0.9, 0.1]), (2, "bad food", meta, [0.0, 1.0])], INDEX)


def test_contexts_and_copies(spark):
    hits = spark.createDataFrame([(7, 0, .91, 1), (7, 1, .8, 2), (7, 2, .7, 3), (7, 99, .6, 4)],
                                 "query_id long, vec_id long, score double, rank int")
    full = retrieval.with_content(hits, index(spark))
    assert full.count() == 3
    assert retrieval.context_blocks(full).first().context.split("\n\n") == [
        "good park\n(source: review|2024-05-03|rating=5.0|kakaomap, similarity: 0.910)",
        " good park \n(source: review|2024-05-03|rating=5.0|kakaomap, similarity: 0.800)",
        "bad food\n(source: review|2024-05-03|rating=5.0|kakaomap, similarity: 0.700)"]
    assert retrieval.chunk_blocks(full).first().context.split("\n\n") == [
        "[Chunk]\ngood park\n(meta: source=kakaomap|s|2024-05-03|rating=5.0)",
        "[Chunk]\nbad food\n(meta: source=kakaomap|s|2024-05-03|rating=5.0)"]
    lists = retrieval.hit_lists(retrieval.document_hits(full)).first().retrieved_reviews
    assert [h.chunk_index for h in lists] == [0, 1, 2]
    assert retrieval.retriever_hits(full.drop("score")).first().score is None


def test_questions_to_prompts(spark):
    texts = ["good park today", "long queue at the gate", "nice food and staff", "rides were closed today"]
    clean = spark.createDataFrame(
        [("kakaomap", i, t, "2024-05-03", 5.0) for i, t in enumerate(texts)],
        "site string, ingest_seq long, content string, date string, rating double")
    built = retrieval.build_index(clean)
    assert [r.vec_id for r in built.orderBy("vec_id").collect()] == [0, 1, 2, 3]
    asked = spark.createDataFrame([(1, "good park today"), (2, "  "), (3, None)], "query_id long, question string")
    got = {r.query_id: r for r in retrieval.search_reviews(built, asked).collect()}
    assert "good park today\n(source: review|2024-05-03|rating=5.0|kakaomap, similarity: 1.000)" in got[1].prompt
    assert got[1].prompt.count("similarity") == got[1].used_count == 3
    assert got[2].reply == got[3].reply == REPLY_BLANK_QUESTION and got[2].prompt is None
    none = retrieval.search_reviews(built.filter("false"), asked.filter("query_id = 1")).first()
    assert (none.reply, none.prompt) == (REPLY_NO_REVIEWS, None)


def test_short_texts_are_not_indexed(spark):
    rows = spark.createDataFrame([("kakaomap", 1, " ten chars ", "d", 1.0), ("kakaomap", 2, "ten chars12", "d", 1.0)],
                                 "site string, ingest_seq long, content string, date string, rating double")
    assert [r.content for r in retrieval.indexable(rows).collect()] == ["ten chars12"]


def test_failing_answers_stay_rows(spark):
    def model():
        def call(prompt):
            if prompt == "bad":
                raise RuntimeError("down")
            return f" {prompt}! "
        return call
    rows = spark.createDataFrame([("hello",), ("bad",), (None,)], "prompt string")
    got = {r.prompt: (r.result, r.error) for r in retrieval.answer(rows, model, "sorry: {error}", trim=True).collect()}
    assert got == {"hello": ("hello!", None), "bad": ("sorry: down", "down"), None: (None, None)}


def mmr(v, query, candidates, k, balance):
    chosen = []
    while len(chosen) < min(k, len(candidates)):
        def value(j):
            near = round(float(v[j] @ query), 6)
            if not chosen:
                return near
            return round(balance * near - (1 - balance) * max(round(float(v[j] @ v[c]), 6) for c in chosen), 6)
        chosen.append(max((j for j in sorted(candidates) if j not in chosen), key=lambda j: (value(j), -j)))
    return chosen


@pytest.mark.parametrize("balance", [0.5, 1.0, 0.2])
def test_diverse_selection_equals_loop(spark, balance):
    v, w, vectors, queries = random_tables(spark, 60, 8, seed=5)
    got = retrieval.diverse(vectors, queries, 5, 12, balance)
    candidates = {q: [j for j, _ in hits] for q, hits in brute(v, w, 12).items()}
    assert {q: [j for j, _ in hits] for q, hits in found(got).items()} == {
        q: mmr(v, w[q], c, 5, balance) for q, c in candidates.items()}


def test_search_modes(spark):
    v, w, vectors, queries = random_tables(spark, 30, 4, seed=6)
    assert found(retrieval.retrieve(vectors, queries, "similarity", 3)) == brute(v, w, 3)
    assert retrieval.retrieve(vectors, queries).groupBy("query_id").count().filter("count <> 5").count() == 0


def test_default_meta(spark):
    row = meta_rows(spark).select(retrieval.with_default_meta(F.col("meta")).alias("m")).collect()[1].m
    assert (row.platform, row.date, row.rating) == ("", "", None)
    assert set(INDEX_META.fieldNames()) == set(row.asDict())


def test_numbers_are_consecutive(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("g"), (F.col("id") * 7).alias("o")).repartition(9)
    got = number_rows(rows, "g", "o", "n", ("a", "b", "c")).orderBy("n").collect()
    assert [r.n for r in got] == list(range(5000))
    assert [(r.g, r.o) for r in got] == sorted((r.g, r.o) for r in got)


def test_rows_without_a_usable_vector_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [0.0, 1.0]), (4, [])]
    stored_rows = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = stored_rows.withColumnRenamed("vec_id", "query_id")
    for size in (64, 0):
        got = knn.nearest(stored_rows, asked, 5, broadcast_bytes=size * 2**20).collect()
        assert {(r.query_id, r.vec_id) for r in got} == {(q, v) for q in (0, 3) for v in (0, 3)}
    assert knn.unusable(stored_rows).first()[0] == 3


def test_a_query_without_hits_has_a_line_that_says_so(spark):
    meta = "struct<platform:string,subject:string,place:string,date:string,rating:double,url:string>"
    hits = spark.createDataFrame([(1, 1, "text", ("k", "s", "p", "d", 5.0, ""), 0.5)],
                                 f"query_id long, rank int, content string, meta {meta}, score double")
    got = {r.query_id: r.references for r in
           retrieval.reference_lists(hits, spark.createDataFrame([(1,), (2,)], "query_id long")).collect()}
    assert got[2] == "   - (관련 후기 없음)" and got[1].startswith('   - "text"')


def test_a_model_sees_each_question_once(spark, tmp_path):
    """Also where the questions are too many to be broadcast."""
    from reviewloom.schemas import INDEX
    seen = tmp_path / "seen"

    def make():
        def model(texts):
            with seen.open("a") as out:
                out.write("".join(f"{t}\n" for t in texts))
            return [[1.0, 0.0] for _ in texts]
        return model

    index = spark.createDataFrame([(0, "one", ("k", "s", "p", "2024-05-03", 5.0, ""), [1.0, 0.0])], INDEX)
    questions = spark.createDataFrame([(n, f"question {n}") for n in range(20)], "query_id long, question string")
    assert retrieval.search_reviews(index, questions, make).count() == 20
    assert sorted(seen.read_text().split("\n"))[1:] == sorted(f"question {n}" for n in range(20))


def test_a_task_hands_on_only_what_reaches_the_score_so_far():
    v, w = np.eye(4)[[0, 1, 2, 3, 0]], np.array([[1.0, .5, 0, 0], [0, 0, 1.0, .9]])
    best = knn._TopK(np.arange(2), w, 3, np.array([.5, -np.inf]))
    best.add(np.arange(5), v)
    hits = best.hits().to_pydict()
    assert list(zip(hits["query_id"], hits["vec_id"], hits["score"])) == [
        (0, 0, 1.0), (0, 4, 1.0), (0, 1, .5), (1, 2, 1.0), (1, 3, .9), (1, 0, 0.0)]


@pytest.mark.parametrize("scale", [1.0, 1e-3, 300.0, 1e13, 1e200])
def test_single_precision_decides_no_hit(scale):
    """Scores that differ less than single precision tells, and components that it does not hold."""
    rng = np.random.default_rng(5)
    v = (rng.normal(0, 1, 16) + rng.normal(0, 1e-7, (300, 16))) * scale
    w = rng.normal(0, 1, (6, 16))
    best = knn._TopK(np.arange(6), w, 7)
    for at in range(0, 300, 100):
        best.add(np.arange(at, at + 100), v[at:at + 100])
    hits, want = best.hits().to_pydict(), brute(v, w, 7)
    assert len(hits["score"]) == 42
    for q in range(6):
        mine = [s for i, s in zip(hits["query_id"], hits["score"]) if i == q]
        assert mine == pytest.approx([s for _, s in want[q]], rel=1e-15, abs=0)


def purposes(monkeypatch):
    """What the search stores, in order."""
    seen, write = [], knn.stored
    monkeypatch.setattr(knn, "stored", lambda df, purpose: seen.append(purpose) or write(df, purpose))
    return seen


@pytest.mark.parametrize("skip_self", [False, True])
def test_many_queries_are_scanned_in_blocks_where_bounds_leave_nothing_out(spark, monkeypatch, skip_self):
    """No query travels to parts of cells if it would meet them all."""
    seen = purposes(monkeypatch)
    v, w, vectors, queries = random_tables(spark, 300, 50, 6, seed=9)
    got = knn.nearest(vectors, queries, 4, skip_self, broadcast_bytes=8 * 6 * 20)
    assert found(got) == brute(v, w, 4, skip_self)
    assert seen.count("hits") == 3 and "asks" not in seen


def test_many_queries_visit_cells_where_bounds_leave_most_out(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL_ROWS", 20)
    seen = purposes(monkeypatch)
    v, w, vectors, queries = clustered(spark)
    assert cells.share_reached(vectors, queries, 8, 4) < knn.CELLS_SHARE
    assert found(knn.nearest(vectors, queries, 4, broadcast_bytes=8 * 8 * 9)) == brute(v, w, 4)
    assert "asks" in seen


def test_hits_are_ranked_when_there_are_enough_of_them(monkeypatch):
    """Not once for every tile of vectors."""
    monkeypatch.setattr(knn, "VECTOR_TILE", 10)
    rng = np.random.default_rng(4)
    v, w, ranked = rng.normal(0, 1, (4000, 12)), rng.normal(0, 1, (30, 12)), []
    best = knn._TopK(np.arange(30), w.astype("float32"), 10)
    rank = best._rank
    best._rank = lambda number: ranked.append(number) or rank(number)
    best.add(np.arange(4000), v.astype("float32"))
    hits = best.hits().to_pandas().sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    want = brute(v.astype("float32").astype(float), w.astype("float32").astype(float), 10)
    assert [(r.vec_id, r.score) for r in hits.itertuples()] == [hit for q in range(30) for hit in want[q]]
    assert len(ranked) < 20


def test_a_model_sees_each_text_of_a_new_index_once(spark, tmp_path):
    """Whether there are any rows, and how many, is told from what was stored."""
    seen = tmp_path / "seen"

    def make():
        def model(texts):
            with seen.open("a") as out:
                out.write("".join(f"{t}\n" for t in texts))
            return [[1.0, 0.0] for _ in texts]
        return model

    clean = spark.createDataFrame([("kakaomap", n, f"a long enough text {n}", "2024-05-03", 5.0) for n in range(20)],
                                  "site string, ingest_seq long, content string, date string, rating double")
    index = tables.load_index(spark, str(tmp_path / "index"), lambda: retrieval.build_index(clean, make_embedder=make))
    assert index.count() == 20
    assert sorted(seen.read_text().split("\n"))[1:] == sorted(f"a long enough text {n}" for n in range(20))
