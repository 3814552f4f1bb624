"""Vectors, classifiers, languages, ensemble and stream."""

import hashlib
import pickle

import numpy as np
import pytest
from row_helpers import rows
from pyspark.sql import functions as F

from tierlabel.operators import dense as D
from tierlabel.operators.catalogue import CatalogueModel
from tierlabel.operators.evaluation import accuracy
from tierlabel.operators.hierarchy import classify, hierarchical_classify
from tierlabel.operators.language import LanguageModel, translate_non_english
from tierlabel.operators import language as L
from tierlabel.operators import sparse, tfidf
from tierlabel.operators.sparse import best_reference
from tierlabel.operators.memory import TranslationMemory
from tierlabel.operators import linear
from tierlabel.operators.linear import Descent, LinearModel, _direction
from tierlabel.operators.tables import split_dataset
from tierlabel.operators.tfidf import TfidfSettings, packed_vectors, tfidf_fit, tfidf_transform
from tierlabel.plans import inputs
from tierlabel.plans.catalog import ORACLE, QUERIES
from tierlabel.plans.bundle import catalogue_handle, load_ensemble, save_ensemble, versions
from tierlabel.plans.ensemble import OUTPUT_COLUMNS, Ensemble, as_items, title_vectors, train, train_and_test
from tierlabel.plans.jobs import classify_file, write_profile
from tierlabel.sources.tables import write_csv
from tierlabel.streaming.scoring import score_stream

GPC = "row_idx long, SegmentTitle string, FamilyTitle string, ClassTitle string"
CATALOGUE = "row_idx long, Sector string, Brand string, Product string, Segment string, Family string, Class string"


def same(a, b):
    assert rows(a) == rows(b)


# --- dense vectors ---


def test_chunked_search_equals_broadcast_search(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    refs = e.withColumnRenamed("vec_id", "reference_id")
    same(D.top_k_similar(e, refs, 3, "vec_id"), D.top_k_similar(e, refs, 3, "vec_id", broadcast_cells=6000))


def test_search_against_brute_force(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").toPandas()
    m = np.vstack(e.embedding).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(m @ m.T, 9)
    np.fill_diagonal(scores, -2)
    want = {int(i): int(j) for i, j in zip(e.vec_id, e.vec_id.to_numpy()[scores.argmax(axis=1)])}
    df = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    got = D.top_k_similar(df, df.withColumnRenamed("vec_id", "reference_id"), 2, "vec_id").filter("vec_id <> reference_id")
    assert {r.vec_id: r.reference_id for r in got.collect()} == want


def test_ties_null_and_zero_vectors(spark):
    targets = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "id int, vector array<double>")
    refs = spark.createDataFrame([(9, [2.0, 0.0]), (4, [1.0, 0.0]), (7, [0.0, 1.0])], "reference_id int, vector array<double>")
    for cells in (1000, 1):
        assert rows(D.cosine_top1(targets, refs, broadcast_cells=cells)) == [(1, 4, 0.0), (3, 4, 1.0)]
    with pytest.raises(ValueError):
        D.top_k_similar(targets, refs, 0)


def test_pairs_at_least_skip_and_stay_exact(spark, small):
    rng = np.random.default_rng(1)
    for dim in (1, 3, 64):
        a, b = D.unit_rows(rng.normal(size=(40, dim))), D.unit_rows(rng.normal(size=(30, dim)) * np.linspace(3, 0.1, dim))
        whole = np.round(a @ b.T, 9)
        for at_least in (-1.0, 0.0, 0.4, 0.9, 1.0):
            row, col, score, dropped = D.pairs_at_least(a, b, at_least)
            assert set(zip(row.tolist(), col.tolist())) == set(map(tuple, np.argwhere(whole >= at_least).tolist()))
            assert score == pytest.approx(whole[row, col], abs=1e-9)
        assert dropped > 0 or dim < 64
    e = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    skipped = spark.sparkContext.accumulator(0)
    near = D.cosine_scores(e, e.withColumnRenamed("vec_id", "reference_id"), "vec_id", at_least=0.97, skipped=skipped)
    full = D.cosine_scores(e, e.withColumnRenamed("vec_id", "reference_id"), "vec_id", broadcast_cells=9000).filter("score >= 0.97")
    same(near, full)
    assert skipped.value > 0


def test_more_neighbours_than_references(spark):
    targets = spark.createDataFrame([(1, [1.0, 0.0])], "id int, vector array<double>")
    refs = spark.createDataFrame([(4, [1.0, 0.0]), (7, [0.0, 1.0])], "reference_id int, vector array<double>")
    for cells in (1000, 1):
        got = D.top_k_similar(targets, refs, 5, broadcast_cells=cells)
        assert rows(got) == [(1, 4, 1.0, 1), (1, 7, 0.0, 2)]


def test_prompt_changes_only_queries(spark):
    df = spark.createDataFrame([(1, "red ring")], "id int, text string")
    docs = df.withColumnRenamed("id", "reference_id")
    assert D.text_scores(df, docs).first().score == 1.0
    assert D.text_scores(df, docs, prompt="query: ").first().score < 1.0


def test_custom_encoder(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abc")], "id int, text string")
    got = D.create_embeddings(df, "text", dim=2, encoder=lambda texts: np.array([[len(t), 1] for t in texts]))
    assert rows(got) == [(1, 2.0, 1.0), (2, 3.0, 1.0)]


def test_encoder_of_empty_text(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "abc")], "id int, text string")
    got = {r.id: r.v for r in df.select("id", D.hashed_encoder(F.col("text"), 8).alias("v")).collect()}
    assert got[1] == [0.0] * 8 and got[2] == [0.0] * 8
    assert abs(sum(x * x for x in got[3]) - 1) < 1e-6


@pytest.mark.parametrize("dim", [6, 64, 128, 1 << 15])
def test_encoder_sends_small_numbers_and_keeps_its_hashes(spark, dim):
    df = spark.createDataFrame([("a red ring",), ("blue",)], "text string")
    got = df.select("text", D.hashed_encoder(F.col("text"), dim).alias("v"))
    kind = "tinyint" if dim <= 64 else "smallint" if dim <= 1 << 14 else "bigint"
    assert f"as {kind})" in got._jdf.queryExecution().analyzed().toString()
    for row in got.collect():
        want = np.zeros(dim)
        for word in row.text.split():
            for i in range(len(word)):
                h = int(hashlib.md5(f" {word} "[i : i + 3].encode()).hexdigest()[:15], 16)
                want[h % dim] += 1 - 2 * (h // dim % 2)
        assert row.v == pytest.approx(list(want / np.linalg.norm(want)), abs=1e-6)


# --- nearest labels ---


def test_classify_one_label_and_ties(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "item_id int, vector array<double>")
    one = spark.createDataFrame([(0, "only", [0.0, 1.0])], "row_idx long, label string, vector array<double>")
    assert rows(classify(items, one)) == [(1, "only", 0.0), (2, "only", 0.0)]
    two = spark.createDataFrame([(5, "b", [1.0, 0.0]), (3, "a", [2.0, 0.0])], "row_idx long, label string, vector array<double>")
    assert [r[1] for r in rows(classify(items, two))] == ["a", "a"]


def tree(spark):
    gpc = spark.createDataFrame(
        [(0, "s1", "shared", "c1"), (1, "s2", "f2", "c2"), (2, "s2", "shared", "c3"), (3, "s3", "f3", "c4")], GPC
    )
    vectors = spark.createDataFrame(
        [("s1", [1.0, 0.0]), ("s2", [0.0, 1.0]), ("s3", [-1.0, 0.0]), ("shared", [1.0, 1.0]), ("f2", [1.0, 0.1]),
         ("f3", [0.0, -1.0]), ("c1", [1.0, 0.0]), ("c2", [0.0, 1.0]), ("c3", [0.5, 1.0]), ("c4", [0.0, 1.0])],
        "title string, vector array<double>",
    )
    return gpc, vectors


@pytest.mark.parametrize("cells", [10_000, 4])
def test_classes_of_a_family_title_under_two_segments_mix(spark, cells):
    gpc, vectors = tree(spark)
    items = spark.createDataFrame([(1, [1.0, 0.9]), (2, [-1.0, 0.0]), (3, None)], "item_id int, vector array<double>")
    got = hierarchical_classify(items, gpc, vectors, broadcast_cells=cells).drop("vector")
    assert rows(got) == [(1, "s1", "shared", "c3"), (2, "s3", "f3", "c4"), (3, None, None, None)]
    got = hierarchical_classify(items, gpc, vectors, labels=["s2", "s3"], broadcast_cells=cells).drop("vector")
    assert rows(got)[0] == (1, "s2", "shared", "c3")


def test_family_is_a_child_of_its_segment(spark, small):
    gpc = inputs.full_taxonomy(spark, small)
    items = inputs.items(spark, small).withColumn("vector", D.hashed_encoder(F.col("product_name")))
    vectors = title_vectors(gpc).persist()
    found = hierarchical_classify(items, gpc, vectors).drop("vector")
    pairs = gpc.select(F.col("SegmentTitle").alias("embed_segment"), F.col("FamilyTitle").alias("embed_family")).distinct()
    assert found.join(pairs, ["embed_segment", "embed_family"], "left_anti").count() == 0
    same(found, hierarchical_classify(items, gpc, vectors, broadcast_cells=2000).drop("vector"))


# --- TF-IDF and catalogue ---


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "b"), (3, None)], "id int, text string")
    idf = {r.token: r.idf for r in tfidf_fit(docs, "text").collect()}
    assert idf == pytest.approx({"a": np.log(4 / 2) + 1, "b": np.log(4 / 3) + 1})
    new = spark.createDataFrame([(7, "a a z b"), (8, "z")], "id int, text string")
    got = {(r.id, r.token): r.weight for r in tfidf_transform(new, "id", "text", tfidf_fit(docs, "text")).collect()}
    a, b = (np.log(2) + 1) * idf["a"], idf["b"]
    assert got == pytest.approx({(7, "a"): a / np.hypot(a, b), (7, "b"): b / np.hypot(a, b)})
    packed = packed_vectors(tfidf_transform(new, "id", "text", tfidf_fit(docs, "text")), "id").first()
    assert packed.terms == ["a", "b"]


@pytest.fixture
def brands(spark):
    rows_ = [(3, "tools", "acme", "red hammer", "s", "f", "hammers"), (1, "food", "milka", "chocolate bar", "s", "f", "sweets"),
             (2, "food", "milka", "chocolate bar", "s2", "f2", "copies"), (4, "food", None, "apple", "s", "f", "fruit")]
    return CatalogueModel.fit(spark.createDataFrame(rows_, CATALOGUE))


@pytest.mark.parametrize("cells", [10_000, 100])
def test_brand_ties_and_unknown_texts(spark, brands, cells):
    items = spark.createDataFrame([(1, "Chocolate bar!"), (2, "nothing known"), (3, None), (4, "hammer"), (5, "chocolate bar")], "item_id int, t string")
    got = {r.item_id: r for r in brands.predict(items, "t", block_bytes=cells).collect()}
    assert [got[i].brand_class for i in (1, 2, 3, 4, 5)] == ["sweets", "sweets", "sweets", "hammers", "sweets"]
    assert [got[i].brand_matched for i in (1, 2, 3, 4, 5)] == [True, False, False, True, True]
    assert got[2].brand_row == 1 and got[2].brand_score == 0.0


def test_brand_paths_agree(spark, small):
    model = CatalogueModel.fit(inputs.catalogue(spark, small))
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    texts = docs.unionByName(inputs.items(spark, small).select(F.col("item_id").alias("doc_id"), F.col("product_name").alias("text")))
    same(model.predict(texts, "text"), model.predict(texts, "text", block_bytes=8000))


def test_load_of_a_missing_model(spark, tmp_path):
    with pytest.raises(Exception):
        CatalogueModel.load(spark, str(tmp_path / "none"))


# --- linear classifier ---


def brute_force_svm(x, y, cost, steps=20_000):
    """Plain gradient descent on the same objective, one class."""
    w = np.zeros(x.shape[1])
    rate = 1.0 / (1.0 + 2.0 * (cost[:, None] * x * x).sum())
    for _ in range(steps):
        short = np.maximum(0, 1 - y * (x @ w))
        w -= rate * (w - 2 * x.T @ (cost * short * y))
    return w


@pytest.mark.parametrize("balanced", [None, "balanced"])
def test_svm_reaches_the_optimum(spark, balanced):
    data = [("red ring", "a"), ("red ring", "a"), ("red bolt", "a"), ("blue ring", "b"), ("blue bolt", "b"), ("red bolt", "c"), ("old gear", "c")]
    train_df = spark.createDataFrame(data, "t string, c string")
    model = LinearModel.fit(train_df, "t", "c", c=2.0, class_weight=balanced, tolerance=1e-6, weight_cells=14)
    idf = {r.token: r.idf for r in model.idf.collect()}
    terms = sorted(idf)
    x = np.zeros((len(data), len(terms) + 1))
    for i, (text, _) in enumerate(data):
        for token in text.split():
            x[i, terms.index(token)] = idf[token]
        x[i] /= np.linalg.norm(x[i])
        x[i, -1] = 1.0
    names = [r.class_name for r in model.classes.orderBy("class_id").collect()]
    got = {(r.class_id, r.token): r.weight for r in model.weights.collect()}
    for k, name in enumerate(names):
        y = np.array([1.0 if c == name else -1.0 for _, c in data])
        positive = len(data) / (len(names) * (y > 0).sum()) if balanced else 1.0
        want = brute_force_svm(x, y, 2.0 * np.where(y > 0, positive, 1.0))
        have = np.array([got.get((k, t), 0.0) for t in [*terms, ""]])
        assert have == pytest.approx(want, abs=2e-3)


@pytest.mark.parametrize("norm", ["l2", "l1", None])
def test_sparse_search_in_blocks_equals_brute_force(spark, norm):
    import random

    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    settings = TfidfSettings(norm=norm)
    docs = spark.createDataFrame([(f"r{i:03}", " ".join(r.choices(words, k=r.randrange(1, 6)))) for i in range(60)], "ref string, t string")
    texts = [None, "", "unknown words", *[" ".join(r.choices([*words, "zz"], k=r.randrange(1, 9))) for _ in range(50)]] * 2
    items = spark.createDataFrame([(i % 7 or None, t) for i, t in enumerate(texts)], "id int, t string").repartition(3)
    idf = tfidf_fit(docs, "t", settings)
    vectors = tfidf_transform(docs, "ref", "t", idf, settings)
    constants = spark.createDataFrame([("r009", "", 0.25), ("r031", "", 0.25), ("r044", "", -1.0)], "ref string, token string, weight double")
    weights = idf.toPandas().set_index("token").idf.to_dict()
    for refs in (vectors, vectors.unionByName(constants), vectors.withColumn("weight", F.when(F.col("ref") < "r030", -F.col("weight")).otherwise(F.col("weight")))):
        by_ref = {}
        for x in refs.collect():
            by_ref.setdefault(x.ref, {})[x.token] = x.weight
        want = []
        for i, t in enumerate(texts):
            tf = {w: (t or "").split().count(w) for w in set((t or "").split()) if w in weights}
            w = {k: (np.log(n) + 1) * weights[k] for k, n in tf.items()}
            size = {"l2": np.sqrt(sum(x * x for x in w.values())), "l1": sum(w.values()), None: 1.0}[norm] or 1.0
            scores = [(round(sum(w[k] / size * v.get(k, 0.0) for k in w) + v.get("", 0.0), 9), ref) for ref, v in by_ref.items()]
            top = max(s for s, _ in scores)
            want.append((i % 7 or None, t, min(ref for s, ref in scores if s == top), pytest.approx(top, abs=1e-8)))
        counts = []
        for block_bytes in (64_000_000, 1500):
            skipped = spark.sparkContext.accumulator(0)
            found = best_reference(items, "t", settings, idf, refs, "ref", block_bytes, skipped)
            got = [tuple(x) for x in found.collect()]
            assert sorted(got, key=repr) == sorted(want, key=repr)
            counts.append(skipped.value)
        assert counts[0] == 0 and counts[1] > 0


def test_sparse_blocks_hold_their_bytes(spark, small):
    catalogue = inputs.catalogue(spark, small)
    model = CatalogueModel.fit(catalogue)
    idf = model.idf.select(F.xxhash64("token").alias("key"), "idf")
    pieces, blocks = sparse._blocks(model.vectors, idf, "row_idx", 4000)
    pieces, blocks = list(pieces), list(blocks)
    assert sum(len(p) for p in pieces) == idf.count() and max(p.nbytes for p in pieces) <= 8000  # by hash, so about the bound
    arrays = lambda b: sum(x.nbytes for x in (b.keys, b.idf, b.refs, b.weights, b.top, b.starts, b.bias)) + b.ids.nbytes
    one = max(len(b.weights) / len(b.ids) for b in blocks) * sparse.POSTING_BYTES
    assert len(blocks) > 3 and max(arrays(b) for b in blocks) <= 4000 + 2 * one
    ids = [i for b in blocks for i in b.ids.to_pylist()]
    assert ids == sorted(ids) == sorted(r.row_idx for r in model.vectors.select("row_idx").distinct().collect())


def test_brands_of_documents_move_no_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    found = CatalogueModel.fit(inputs.catalogue(spark, small)).handle().references.search(docs, "text")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_minimiser_on_a_quadratic():
    scale = np.array([[1.0, 100.0], [10.0, 1.0], [0.1, 5.0]])
    goal = np.array([[1.0, 2.0], [3.0, -1.0], [0.5, 0.25]])

    def loss(w):
        return (scale * (w - goal) ** 2).sum(axis=0), 2 * scale * (w - goal)

    at = Descent(np.zeros((3, 2)))
    for _ in range(200):
        at.step(*loss(at.trial()), 1.0, 1e-8)
    assert not at.active().any()
    w = at.w
    assert w == pytest.approx(goal * 2 * scale / (1 + 2 * scale), abs=1e-5)
    assert (_direction(np.ones((3, 2)), [], []) == -1).all()


def fitted(train, **options):
    model = LinearModel.fit(train, "t", "c", TfidfSettings(min_df=2), **options)
    return {(r.class_id, r.token): r.weight for r in model.weights.collect()}


def test_svm_in_groups_parts_and_tiny_holds(spark, monkeypatch):
    import random

    r = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    data = [(" ".join(r.choices(words[k * 2 : k * 2 + 12], k=5)), f"c{k}") for k in range(4) for _ in range(40)]
    train = spark.createDataFrame([*data, (None, "c0"), ("", "c1"), ("w1 w2", None)], "t string, c string").repartition(9)
    close = {"class_weight": "balanced", "tolerance": 1e-7, "max_passes": 500}  # the optimum is unique
    whole = fitted(train, **close)
    monkeypatch.setattr(linear, "FAN_IN", 2)
    monkeypatch.setattr(linear, "HELD_BYTES", 1)
    monkeypatch.setattr(linear, "SCORE_CELLS", 200)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        pieces = fitted(train, **close, weight_cells=1)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert whole.keys() == pieces.keys()
    assert [pieces[k] for k in whole] == pytest.approx(list(whole.values()), abs=1e-4)


def test_svm_in_pieces_of_the_vocabulary(spark, tmp_path, monkeypatch):
    """A task holds a piece of a group's weights; the pieces agree on every step, and nothing but the last states is left."""
    import random

    r = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    data = [(" ".join(r.choices(words[k * 10 : k * 10 + 20], k=6)), f"c{k}") for k in range(3) for _ in range(20)]
    train = spark.createDataFrame([*data, (None, "c0"), ("", "c1"), ("w1 w2", None)], "t string, c string").repartition(2)
    close = {"class_weight": "balanced", "tolerance": 1e-4}  # the optimum is unique
    whole = fitted(train, **close)
    monkeypatch.setattr(linear, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(linear, "PIECE_TERMS", 15, raising=False)
    monkeypatch.setattr(linear, "HELD_BYTES", 300)
    pieces = fitted(train, **close, weight_cells=40)
    assert whole.keys() == pieces.keys()
    assert [pieces[k] for k in whole] == pytest.approx(list(whole.values()), abs=3e-3)
    left = sorted(p.name for p in (tmp_path / "linear").iterdir() if not p.name.startswith("."))
    assert len(left) == 2 and "training" in left
    states = spark.read.parquet(str(tmp_path / "linear" / left[0])).select("state").collect()
    cells = [pickle.loads(x.state).w.size for x in states]
    assert len(whole) <= sum(cells) <= 3 * 41 and max(cells) <= 40  # not all terms of a class


def test_wide_references_are_cut(spark, monkeypatch):
    """A reference that is larger than a block is not held as a whole, and its scores are the same."""
    import random

    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    idf = spark.createDataFrame([(w, 1.0 + i / 60) for i, w in enumerate(words)], "token string, idf double")
    weights = [(f"r{k}", w, r.uniform(-1, 1)) for k in range(5) for w in [*words, ""] if r.random() < 0.9]
    refs = spark.createDataFrame(weights, "ref string, token string, weight double")
    texts = [None, "", "zz", *[" ".join(r.choices([*words, "zz"], k=r.randrange(1, 12))) for _ in range(60)]] * 2
    items = spark.createDataFrame([(i % 9 or None, t) for i, t in enumerate(texts)], "id int, t string").repartition(3)
    for norm in ("l2", "l1", None):
        settings = TfidfSettings(norm=norm)
        want = sorted(map(tuple, best_reference(items, "t", settings, idf, refs, "ref").collect()), key=repr)
        built = []
        with monkeypatch.context() as m:
            for name, value in (("WIDE_CLASSES", 2), ("WIDE_CELLS", 30), ("HELD_BYTES", 500)):
                m.setattr(sparse, name, value, raising=False)
            build = sparse.Block.build
            m.setattr(sparse.Block, "build", lambda *a: built.append(len(a[0])) or build(*a))
            got = sorted(map(tuple, best_reference(items, "t", settings, idf, refs, "ref", 1500).collect()), key=repr)
        assert max(built, default=0) * sparse.POSTING_BYTES <= 1500
        assert [x[:3] for x in got] == [x[:3] for x in want]
        assert [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=1e-8)


def test_svm_training_shuffles_no_texts_and_leaves_no_sums(spark, tmp_path, monkeypatch):
    """Texts are no key of the token rows, and the sums of a pass go with it."""
    monkeypatch.setattr(linear, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    asked = []
    if hasattr(linear, "tfidf_transform"):
        monkeypatch.setattr(linear, "tfidf_transform", lambda *a: asked.append(a[1]) or tfidf_transform(*a))
    train = spark.createDataFrame([("a b c", "x"), ("b c d", "y"), ("a a", "x"), ("", "y")], "t string, c string")
    LinearModel.fit(train, "t", "c")
    assert not asked
    left = sorted(p.name for p in (tmp_path / "linear").iterdir() if not p.name.startswith("."))
    assert len(left) == 2 and "training" in left  # and the last states


def test_svm_jobs_do_not_grow_with_groups_and_no_silent_stop(spark):
    data = [(f"{a} {b} {a}{b}", f"c{a}") for a in range(6) for b in range(6)]
    train = spark.createDataFrame(data, "t string, c string")
    tracker, counts = spark.sparkContext.statusTracker(), []
    for cells in (10_000, 1):
        spark.sparkContext.setJobGroup(f"svm {cells}", "")
        LinearModel.fit(train, "t", "c", weight_cells=cells)
        counts.append(len(tracker.getJobIdsForGroup(f"svm {cells}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] < 1.5 * counts[0]  # six groups instead of one; the number of passes differs a little
    with pytest.raises(RuntimeError, match="have not converged in 1 passes"):
        LinearModel.fit(train, "t", "c", max_passes=1)
    with pytest.raises(ValueError, match="no training rows"):
        LinearModel.fit(train.filter("false"), "t", "c")


def test_svm_saved_loaded_and_both_paths(spark, small, tmp_path):
    items = inputs.items(spark, small)
    with pytest.raises(ValueError):
        LinearModel(TfidfSettings()).save(str(tmp_path / "m"))
    model = LinearModel.fit(items, "product_name", "class")
    model.save(str(tmp_path / "m"))
    loaded = LinearModel.load(spark, str(tmp_path / "m"))
    found = model.predict(items, "product_name", inputs.taxonomy(spark, small))
    same(found, loaded.predict(items, "product_name", inputs.taxonomy(spark, small)))
    same(found, model.predict(items, "product_name", inputs.taxonomy(spark, small), block_bytes=20_000))


def test_svm_beats_the_largest_class_on_held_out_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    split = split_dataset(docs, "doc_id", "lang")
    train_df, test_df = split.filter("NOT is_test"), split.filter("is_test")
    svm = LinearModel.fit(train_df, "text", "lang", TfidfSettings(min_df=2)).predict(test_df, "text")
    bayes = LanguageModel.fit(train_df, "text", "lang").detect(test_df, "text", "found")
    share = [r["count"] for r in test_df.groupBy("lang").count().collect()]
    largest = max(share) / sum(share)
    assert svm.filter("lang = clf_class").count() / sum(share) > max(largest, 0.9)
    assert bayes.filter("lang = found").count() / sum(share) > max(largest, 0.9)


# --- languages ---


def test_translation(spark):
    items = spark.createDataFrame(
        [(1, "rote Uhr", "de"), (2, "red ring", "en"), (3, "neu", "de"), (4, "neu", "de"), (5, "x", None), (6, None, "de")],
        "id int, t string, lang string",
    )
    memory = spark.createDataFrame([("rote Uhr", "red clock"), ("red ring", "WRONG")], "source string, translation string")
    got = translate_non_english(items, "t", "lang", memory).select("id", "t", "translated")
    assert rows(got) == [(1, "rote Uhr", "red clock"), (2, "red ring", "red ring"), (3, "neu", "neu"), (4, "neu", "neu"), (5, "x", "x"), (6, None, None)]
    got = translate_non_english(items, "t", "lang", memory, lambda texts: [t.upper() for t in texts]).select("id", "translated")
    assert rows(got)[:4] == [(1, "red clock"), (2, "red ring"), (3, "NEU"), (4, "NEU")]
    assert rows(translate_non_english(items, "t", "lang").select("translated")) == rows(items.select("t"))


def test_the_blocks_of_a_stage_pass_by_in_one_worker(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "id long, __vector array<double>")
    found = D.best_matches(vectors, vectors, 2, "id", "id", broadcast_cells=60)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    same(found.select("id", "__refs"), D.best_matches(vectors, vectors, 2, "id", "id").select("id", "__refs"))
    texts = spark.createDataFrame([(i, f"a{i % 9} b{i % 5} c") for i in range(60)], "id long, t string")
    idf = tfidf_fit(texts, "t")
    weights = tfidf_transform(texts, "id", "t", idf)
    found = best_reference(texts, "t", TfidfSettings(), idf, weights, "id", 2000)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 2  # norms, and all blocks
    same(found, best_reference(texts, "t", TfidfSettings(), idf, weights, "id"))


def test_a_task_compares_equal_texts_once(spark):
    texts = spark.createDataFrame([(i, f"a{i % 9} b{i % 5} c") for i in range(60)], "id long, t string")
    idf = tfidf_fit(texts, "t")
    weights = tfidf_transform(texts, "id", "t", idf)
    asked = texts.unionByName(texts).unionByName(texts).coalesce(1).orderBy("id")
    skipped = {}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)
    try:
        for name, given in (("once", texts.coalesce(1)), ("thrice", asked.coalesce(1))):
            skipped[name] = spark.sparkContext.accumulator(0)
            found = best_reference(given, "t", TfidfSettings(), idf, weights, "id", 2000, skipped[name])
            got = found.select("t", "__ref", "__score").distinct()
            assert rows(got) == rows(best_reference(texts, "t", TfidfSettings(), idf, weights, "id").select("t", "__ref", "__score").distinct())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert 0 < skipped["thrice"].value <= skipped["once"].value


def test_catalogue_labels_come_with_the_search(spark):
    """One Python worker a task, with the labels of texts that match nothing too; more blocks and a join give the same."""
    catalogue = spark.createDataFrame([(i, f"s{i}", f"b{i}", f"p{i}", f"s{i}", None if i == 3 else f"f{i}", f"c{i}") for i in range(2, 9)], CATALOGUE)
    items = spark.createDataFrame([(1, "p4"), (2, "b3 p3"), (3, "no such word"), (4, None)], "Segment int, t string")
    model = CatalogueModel.fit(catalogue)
    found = model.predict(items, "t")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    want = {1: ("s4", "f4", "c4"), 2: ("s3", None, "c3"), 3: ("s2", "f2", "c2"), 4: ("s2", "f2", "c2")}
    assert {r.Segment: (r.brand_segment, r.brand_family, r.brand_class) for r in found.collect()} == want
    same(found, model.predict(items, "t", block_bytes=300))


def test_detection_takes_texts_in_slices(spark, monkeypatch):
    docs = spark.createDataFrame([("the ring and the bolt", "en"), ("la rueda y el perno", "es"), ("", "en")], "text string, lang string")
    model = LanguageModel.fit(docs, "text", "lang")
    asked = docs.select("text").unionByName(docs.select("text")).unionByName(spark.createDataFrame([(None,)], "text string")).coalesce(1)
    want = rows(model.detect(asked, "text"))
    assert list(L._slices([3, 4, 5, 50, 0, 2], 10)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    monkeypatch.setattr(L, "DETECT_SLICE", 1)
    assert rows(model.detect(asked, "text")) == want


def test_hashes_are_taken_in_slices(spark, monkeypatch):
    monkeypatch.setattr(D, "TOKEN_SLICE", 10, raising=False)
    length = np.array([3, 4, 5, 50, 0, 0, 2])
    assert list(D.token_slices(length)) == [(0, 2), (2, 3), (3, 4), (4, 7)] and list(D.token_slices(length[:0])) == []


def test_a_task_counts_a_bounded_number_of_tokens(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tfidf, "TASK_TOKENS", 1000, raising=False)
    spark.range(2000).selectExpr("id AS p_partkey", "'A' AS p_type", "'B' AS p_brand", "concat('part ', id) AS p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    docs = spark.read.parquet(f"{tmp_path}/part.parquet")
    counted = [tfidf.term_counts(docs, "p_partkey", "p_name", TfidfSettings()), *[QUERIES[f"v01_tokenize_{n}"](spark, str(tmp_path)) for n in ("word_pairs", "within_words")]]
    for found in counted:
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) >= 4000 and max(sizes) <= 3000


def test_a_text_of_two_languages(spark, tmp_path):
    items = spark.createDataFrame([(1, "de la", "fr"), (2, "de la", "es"), (3, "de la", "en"), (4, "de la", None)], "id int, t string, __lang string")
    memory = spark.createDataFrame([("de la", "fr", "of the"), ("de la", "it", "WRONG")], "source string, lang string, translation string")
    got = translate_non_english(items, "t", "__lang", memory)
    assert got.columns == ["id", "t", "__lang", "translated"]
    assert [r.translated for r in got.orderBy("id").collect()] == ["of the", "de la", "de la", "de la"]
    got = translate_non_english(items, "t", "__lang", memory, lambda texts: [t.upper() for t in texts])
    assert [r.translated for r in got.orderBy("id").collect()] == ["of the", "DE LA", "de la", "de la"]
    docs = items.filter("__lang IS NOT NULL").toDF("doc_id", "text", "lang")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.createOrReplaceTempView("documents")
    same(QUERIES["x06_translate_non_english"](spark, str(tmp_path)), spark.sql(ORACLE["x06_translate_non_english"]))


def test_language_of_short_and_empty_texts(spark):
    docs = spark.createDataFrame([("the ring the", "en"), ("der ring der", "de"), ("den ding", "de")], "t string, lang string")
    model = LanguageModel.fit(docs, "t", "lang")
    texts = spark.createDataFrame([(1, "the"), (2, "der"), (3, ""), (4, None), (5, "zzzz")], "id int, t string")
    got = {r.id: r.lang for r in model.detect(texts, "t").collect()}
    # unknown n-grams count a little against the language with more text, here less than its prior is worth
    assert got == {1: "en", 2: "de", 3: "de", 4: "de", 5: "de"}


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_detection_against_counting_by_hand(spark, n, monkeypatch, tmp_path):
    from collections import Counter
    from math import log

    known = [("the ring the", "en"), ("", "en"), ("der rïng der 😀😀", "de"), ("den ding", "de"), ("anillo", "es"), (None, "es"), ("x", None)]
    asked = ["the", "DER", "", None, "zzzz", "rïng 😀", "anillo the der", "the"]
    grams = lambda t: [t[i : i + n] for i in range(len(t) - n + 1)]
    counts, texts = {}, Counter()
    for t, lang in known:
        if t is not None and lang is not None:
            texts[lang] += 1
            counts.setdefault(lang, Counter()).update(grams(t))
    size = len({g for c in counts.values() for g in c})
    want = []
    for t in asked:
        scores = [(round(log(texts[x] / sum(texts.values())) + sum(log((counts[x][g] + 1) / (sum(counts[x].values()) + size)) for g in grams((t or "").lower())), 6), x) for x in sorted(texts)]
        want.append(max(scores, key=lambda s: s[0])[::-1])
    model = LanguageModel.fit(spark.createDataFrame(known, "t string, l string"), "t", "l", n)
    ids = [1, 1, None, None, 2, 3, 4, 5]
    df = spark.createDataFrame(list(zip(ids, asked)), "id int, t string").coalesce(1)
    model.save(str(tmp_path / "m"))
    for which, cells in ((model, 8_000_000), (model, 8), (LanguageModel.load(spark, str(tmp_path / "m")), 30)):
        found = which.detect(df, "t", broadcast_cells=cells).collect()
        assert [r.id for r in found] == ids
        assert [(r.lang, pytest.approx(r.lang_score, abs=2e-6)) for r in found] == want
    monkeypatch.setattr("tierlabel.operators.language.DENSE_CODES", 0)  # by sorting
    assert [(r.lang, pytest.approx(r.lang_score, abs=2e-6)) for r in model.detect(df, "t").collect()] == want
    nothing = LanguageModel.fit(df.withColumn("l", F.lit(None).cast("string")), "t", "l").detect(df, "t")
    assert [r.lang for r in nothing.collect()] == [None] * len(ids)


def test_dense_and_sorted_grams_agree(monkeypatch):
    texts = ["", "a", "abcab", "😀b😀b😀", "abc" * 50]
    dense = [L.distinct_grams(texts, n) for n in (1, 2, 3, 4)]
    monkeypatch.setattr(L, "DENSE_CODES", -1)
    for n, (row, place, codes) in zip((1, 2, 3, 4), dense):
        other = L.distinct_grams(texts, n)
        assert row.tolist() == other[0].tolist() and codes[place].tolist() == other[2][other[1]].tolist()
    assert [len(x) for x in L.distinct_grams([], 3)] == [0, 0, 0] and [len(x) for x in L.distinct_grams(["", "ab"], 3)] == [0, 0, 0]


def test_detection_does_not_move_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = LanguageModel.fit(docs, "text", "lang").detect(docs.drop("lang"), "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


def test_memory_grows_once_per_text_and_batch(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def translator(texts):
        calls.add(len(texts))
        return [t.upper() for t in texts]

    memory = TranslationMemory(spark, str(tmp_path / "memory"))
    assert memory.table().collect() == [] and memory.batches() == []
    items = spark.createDataFrame([("a", "de"), ("a", "de"), ("b", "fr"), ("c", "en"), (None, "de"), ("d", None)], "t string, l string")
    assert memory.add(items.limit(2), "t", "l", translator, 1) and calls.value == 1
    assert memory.add(items, "t", "l", translator, "2") and calls.value == 2  # only b is new
    assert not memory.add(items, "t", "l", translator, "2") and calls.value == 2  # the batch is there
    assert memory.add(items, "t", "l", translator, 3) and calls.value == 2  # nothing is missing
    assert rows(memory.table()) == [("a", "A"), ("b", "B")] and memory.batches() == ["1", "2", "3"]
    # a batch that was cut off does not count and is written anew
    (tmp_path / "memory" / "batch=2" / "_SUCCESS").unlink()
    assert rows(memory.table()) == [("a", "A")]
    assert memory.add(items, "t", "l", translator, 2) and calls.value == 3
    assert rows(memory.table()) == [("a", "A"), ("b", "B")]
    assert rows(translate_non_english(items, "t", "l", memory.table()).select("translated")) == rows(spark.createDataFrame([("A",), ("A",), ("B",), ("c",), (None,), ("d",)], "t string"))
    with pytest.raises(ValueError):
        memory.add(items, "t", "l", translator, "a/b")


def test_ensemble_detects_translates_and_remembers(spark, small, tmp_path):
    gpc, catalogue = inputs.full_taxonomy(spark, small), inputs.catalogue(spark, small)
    model = CatalogueModel.fit(catalogue)
    third = lambda df: df.select("*", *[F.col(f"brand_{lv}").alias(f"clf_{lv}") for lv in ("segment", "family", "class")])
    languages = LanguageModel.fit(spark.createDataFrame([("the red ring", "en"), ("der rote Ring für das Kind", "de")], "t string, l string"), "t", "l")
    calls = spark.sparkContext.accumulator(0)
    first = model.rows.join(catalogue, "row_idx").orderBy("row_idx").first()

    def translator(texts):
        calls.add(len(texts))
        return [f"{first.Brand} {first.Product}" for _ in texts]

    memory = TranslationMemory(spark, str(tmp_path / "m"))
    ensemble = Ensemble(gpc, model, third, title_vectors(gpc), memory=memory, translator=translator, languages=languages)
    items = spark.createDataFrame([(1, "der rote Ring für das"), (1, "der rote Ring für das"), (None, "the ring")], "item_id int, product_name string")
    for batch in ("a", "a", "b"):
        found = ensemble.flat(items, batch=batch).collect()
        assert [r.brand_class for r in found if r.product_name.startswith("der")] == [first.Product] * 2 and len(found) == 3
    assert calls.value == 1


# --- ensemble and stream ---


def test_ensemble_output_and_test_job(spark, small, tmp_path):
    items = inputs.items(spark, small)
    gpc, catalogue = inputs.full_taxonomy(spark, small), inputs.catalogue(spark, small)
    ensemble, _ = train(items, gpc, catalogue)
    flat = ensemble.flat(items.select("item_id", "product_name"))
    assert tuple(flat.columns) == OUTPUT_COLUMNS
    found = flat.collect()
    assert len(found) == items.count()
    assert {round(r.confidence_rate * 3) for r in found} <= {1, 2, 3}
    classes = {r.ClassTitle: (r.SegmentTitle, r.FamilyTitle) for r in gpc.orderBy(F.desc("row_idx")).collect()}
    assert all(classes[r.pred_class] == (r.pred_segment, r.pred_family) for r in found)

    split = split_dataset(items, "item_id")
    scores = train_and_test(
        split.filter("NOT is_test"), split.filter("is_test"), gpc, catalogue, output=str(tmp_path / "predictions.csv")
    )
    assert {r.model for r in scores.collect()} == {"linear", "catalogue", "embedding", "ensemble"}
    assert spark.read.option("header", True).csv(str(tmp_path / "predictions.csv")).count() == split.filter("is_test").count()


def test_equal_items_are_fitted_on_and_scored_once(spark, small, tmp_path, monkeypatch):
    items = inputs.items(spark, small).drop("item_id")
    items = items.unionByName(items.filter("class LIKE 'h%'")).unionByName(items).repartition(5)
    gpc, catalogue, memory = inputs.full_taxonomy(spark, small), inputs.catalogue(spark, small), inputs.item_memory(spark, small)
    held_out = items.filter("family < 'Brand#2'").unionByName(items.orderBy(*items.columns).limit(1).withColumn("product_name", F.lit(None).cast("string")))
    fitted, scored = [], []
    fit, run = LinearModel.fit.__func__, Ensemble.run
    monkeypatch.setattr(LinearModel, "fit", classmethod(lambda cls, rows, *a, **o: fitted.append(rows.count()) or fit(cls, rows, *a, **o)))
    monkeypatch.setattr(Ensemble, "run", lambda self, rows, **o: scored.append(rows.count()) or run(self, rows, **o))
    options = {"lang": "lang", "memory": memory}
    once = rows(train_and_test(items, held_out, gpc, catalogue, **options))
    every = rows(train_and_test(items, held_out, gpc, catalogue, output=str(tmp_path / "predictions.csv"), **options))
    assert once == every
    assert fitted == [items.select("product_name", "lang", "class").distinct().count()] * 2
    assert scored == [held_out.distinct().count(), held_out.count()]


def test_models_read_their_tables_once(spark, small):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    items, catalogue = inputs.items(spark, small).repartition(3), inputs.catalogue(spark, small)
    LinearModel.fit(items.select(seen("product_name").alias("t"), "class"), "t", "class")
    assert read.value == items.count()
    read.value = 0
    model = CatalogueModel.fit(catalogue.repartition(3).withColumn("Product", seen("Product")).withColumn("Class", seen("Class")))
    model.predict(items, "product_name").count()
    assert read.value == 2 * catalogue.count()


def test_copies_count_as_rows(spark):
    each = [("a b", "x", "x", 2), ("b c", "y", "x", 3), ("", None, None, 1), (None, "x", "x", 1)]
    packed = spark.createDataFrame(each, "t string, class string, pred_class string, n long")
    loose = packed.withColumn("i", F.explode(F.sequence(F.lit(1), "n"))).drop("n", "i")
    assert rows(tfidf_fit(packed, "t", copies="n")) == rows(tfidf_fit(loose, "t"))
    assert rows(accuracy(packed, ["class"], copies="n")) == rows(accuracy(loose, ["class"])) == [(round(3 / 7, 9),)]
    assert rows(accuracy(packed.limit(0), ["class"], copies="n")) == rows(accuracy(loose.limit(0), ["class"])) == [(None,)]
    options = {"tolerance": 1e-7, "max_passes": 500, "class_weight": "balanced"}
    whole, counted = (
        {(r.class_id, r.token): r.weight for r in LinearModel.fit(df, "t", "class", **options, **o).weights.collect()}
        for df, o in ((loose, {}), (packed, {"copies": "n"}))
    )
    assert whole.keys() == counted.keys()
    assert [counted[k] for k in whole] == pytest.approx(list(whole.values()), abs=1e-6)


def test_jobs_from_files_to_files(spark, small, tmp_path):
    gpc, catalogue = inputs.full_taxonomy(spark, small), inputs.catalogue(spark, small)
    model = CatalogueModel.fit(catalogue)
    third = lambda df: df.select("*", *[F.col(f"brand_{lv}").alias(f"clf_{lv}") for lv in ("segment", "family", "class")])
    ensemble = Ensemble(gpc, model, third, title_vectors(gpc))
    source, out = str(tmp_path / "items.csv"), str(tmp_path / "classified")
    names = inputs.items(spark, small).select("product_name", F.col("item_id").alias("note"))
    write_csv(names.unionByName(names), source)
    classify_file(spark, ensemble, source, "product_name string, note long", out)
    found = spark.read.option("header", True).csv(out)
    assert found.count() == names.select("product_name").distinct().count()
    assert found.filter("pred_class IS NULL").count() == 0
    assert found.columns == ["product_name", "note", *OUTPUT_COLUMNS[1:]]

    one = ensemble.flat(as_items(spark, "Brand#1 red ring")).collect()
    assert len(one) == 1 and one[0].product_name == "Brand#1 red ring" and one[0].pred_class is not None

    labelled = ensemble.run(inputs.items(spark, small))
    reports = write_profile(labelled, inputs.items(spark, small), gpc, str(tmp_path / "profile"))
    assert len(reports) == 19
    for name in reports:
        assert spark.read.option("header", True).csv(str(tmp_path / "profile" / name)).count() > 0


def test_stream_equals_batch_and_continues(spark, small, tmp_path):
    items = inputs.items(spark, small).select("item_id", "product_name")
    model = CatalogueModel.fit(inputs.catalogue(spark, small))
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    halves = items.randomSplit([0.5, 0.5], seed=1)
    for i, half in enumerate(halves):
        half.repartition(2).write.mode("append").parquet(source)
        score_stream(spark, source, items.schema, lambda b: model.predict(b, "product_name"), sink, state, 1).awaitTermination()
    same(spark.read.parquet(sink).drop("batch_id"), model.predict(items, "product_name"))


def test_bundle_and_stream_handle(spark, small, tmp_path):
    items = inputs.items(spark, small).select("item_id", "product_name", "class")
    gpc, catalogue = inputs.full_taxonomy(spark, small), inputs.catalogue(spark, small)
    languages = LanguageModel.fit(inputs.items(spark, small), "product_name", "lang")
    memory = spark.createDataFrame([("a", "b")], "source string, translation string")
    ensemble, linear = train(items, gpc, catalogue, languages=languages, memory=memory)
    folder = str(tmp_path / "bundle")
    with pytest.raises(FileNotFoundError):
        load_ensemble(spark, folder)
    assert save_ensemble(ensemble, linear, folder) == "version-000001"
    loaded = load_ensemble(spark, folder)
    asked = items.drop("class").limit(40)
    same(ensemble.flat(asked), loaded.flat(asked))
    assert loaded.dim == ensemble.dim and rows(loaded.memory) == [("a", "b")] and loaded.languages.languages == languages.languages

    # a version without a manifest is not there; one that lacks a part is an error
    (tmp_path / "bundle" / "version-000002").mkdir()
    assert versions(spark, folder) == ["version-000001"]
    handle = catalogue_handle(spark, folder)
    first = handle.get()
    first.predict(asked, "product_name").collect()
    spark.sparkContext.setJobGroup("second batch", "")
    assert handle.get() is first
    again = handle.get().predict(asked, "product_name")
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("second batch") == []
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "Subquery" not in plan
    spark.sparkContext.setJobGroup("rest", "")

    smaller = CatalogueModel.fit(catalogue.filter("row_idx < 20"))
    ensemble.brands, ensemble.memory = smaller, TranslationMemory(spark, str(tmp_path / "memory"))
    assert save_ensemble(ensemble, linear, folder) == "version-000003"
    assert handle.get() is not first and handle.version == "version-000003"
    same(handle.get().predict(asked, "product_name"), smaller.predict(asked, "product_name"))
    assert load_ensemble(spark, folder).memory.path == str(tmp_path / "memory")
    (tmp_path / "bundle" / "version-000003" / "linear" / "weights" / "_SUCCESS").unlink()
    with pytest.raises(FileNotFoundError, match="linear/weights"):
        load_ensemble(spark, folder)
    same(load_ensemble(spark, folder, "version-000001").flat(asked), loaded.flat(asked))


@pytest.mark.parametrize("partitions", [1, 16])
def test_results_do_not_depend_on_partitions(spark, small, partitions):
    items = inputs.items(spark, small).select("item_id", "product_name")
    want = rows(CatalogueModel.fit(inputs.catalogue(spark, small)).predict(items, "product_name"))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = rows(CatalogueModel.fit(inputs.catalogue(spark, small)).predict(items.repartition(partitions), "product_name"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == want
