"""Queries for tokens, TF-IDF, dense vectors, classifiers, languages, the ensemble and the stream."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tierlabel.functions.text import tokens
from tierlabel.operators import dense as D
from tierlabel.operators import groups as G
from tierlabel.operators.catalogue import CatalogueModel
from tierlabel.operators.hierarchy import classify, hierarchical_classify
from tierlabel.operators.language import LanguageModel, translate_non_english
from tierlabel.operators.linear import LinearModel, label_lookup
from tierlabel.operators.memory import TranslationMemory
from tierlabel.operators.tables import lookup_join, result_table
from tierlabel.operators.tfidf import TfidfSettings, term_counts, tfidf_fit, tfidf_transform
from tierlabel.plans import inputs
from tierlabel.plans.bundle import load_ensemble, save_ensemble
from tierlabel.plans.ensemble import OUTPUT_COLUMNS, Ensemble, title_vectors, train, train_and_test
from tierlabel.plans.inputs import table
from tierlabel.plans.jobs import classify_file
from tierlabel.plans.registry import query
from tierlabel.session import scratch_path
from tierlabel.sources.tables import read_table, write_csv
from tierlabel.streaming.scoring import score_stream

# --- tokens and TF-IDF --------------------------------------------------------------------------------

WORDS_SQL = r"unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+'))"


@query(
    "v01_tokenize_words",
    f"""SELECT token, CAST(count(*) AS BIGINT) AS n FROM (SELECT {WORDS_SQL.format(text='text')} AS token FROM documents) t
        GROUP BY token""",
)
def tokenize_words(spark, sf):
    found = table(spark, sf, "documents").select(F.explode(tokens(F.col("text"))).alias("token"))
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "v01_tokenize_stop_words",
    f"""SELECT token, CAST(count(*) AS BIGINT) AS n FROM (SELECT {WORDS_SQL.format(text='text')} AS token FROM documents) t
        WHERE token NOT IN ('the', 'of', 'la', 'der') GROUP BY token""",
)
def tokenize_stop_words(spark, sf):
    found = tokens(F.col("text"), stop_words=("the", "of", "la", "der"))
    rows = table(spark, sf, "documents").select(F.explode(found).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "v01_tokenize_accents",
    f"""SELECT token, CAST(count(*) AS BIGINT) AS n FROM (SELECT {WORDS_SQL.format(text='strip_accents(text)')} AS token FROM documents) t
        GROUP BY token""",
)
def tokenize_accents(spark, sf):
    rows = table(spark, sf, "documents").select(F.explode(tokens(F.col("text"), strip_accents=True)).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "v01_tokenize_word_pairs",
    r"""WITH w AS (SELECT p_partkey, regexp_extract_all(lower(p_type || ' ' || p_brand || ' ' || p_name), '[\p{L}\p{N}_]+') AS ws FROM part),
             g AS (SELECT p_partkey, unnest(ws) AS token FROM w UNION ALL
                   SELECT p_partkey, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w)
        SELECT p_partkey, token, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY p_partkey, token""",
)
def tokenize_word_pairs(spark, sf):
    text = F.concat_ws(" ", "p_type", "p_brand", "p_name")
    rows = table(spark, sf, "part").select("p_partkey", text.alias("text"))
    return term_counts(rows, "p_partkey", "text", TfidfSettings(ngram_range=(1, 2))).withColumnRenamed("tf", "n")


@query(
    "v01_tokenize_characters",
    r"""WITH s AS (SELECT string_split(regexp_replace(lower(text), '\s\s+', ' ', 'g'), '') AS t FROM documents)
        SELECT token, CAST(count(*) AS BIGINT) AS n FROM
          (SELECT unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || t[i + 1] || t[i + 2])) AS token FROM s) g GROUP BY token""",
)
def tokenize_characters(spark, sf):
    found = table(spark, sf, "documents").select(F.explode(tokens(F.col("text"), "char", (3, 3))).alias("token"))
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "v01_tokenize_within_words",
    r"""WITH w AS (SELECT p_partkey, ' ' || unnest(string_split_regex(lower(p_brand || ' ' || p_name), '\s+')) || ' ' AS w FROM part),
             n AS (SELECT unnest([3, 4]) AS n),
             g AS (SELECT p_partkey, unnest(list_transform(range(1, len(w) - n + 2), lambda i: substr(w, i, n))) AS token
                   FROM w, n WHERE len(w) >= n)
        SELECT p_partkey, token, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY p_partkey, token""",
)
def tokenize_within_words(spark, sf):
    text = F.concat("p_brand", F.lit(" "), "p_name")
    rows = table(spark, sf, "part").select("p_partkey", text.alias("text"))
    return term_counts(rows, "p_partkey", "text", TfidfSettings("char_wb", (3, 4))).withColumnRenamed("tf", "n")


_DOCUMENT_TF_SQL = f"""tf AS (SELECT doc_id, token, count(*) AS tf FROM
      (SELECT doc_id, {WORDS_SQL.format(text='text')} AS token FROM documents) t GROUP BY doc_id, token),
    idf AS (SELECT token, count(*) AS df, ln((1 + (SELECT count(*) FROM documents)) / (1.0e0 + count(*))) + 1 AS idf FROM tf GROUP BY token)"""


@query(
    "v02_tfidf_fit",
    f"WITH {_DOCUMENT_TF_SQL} SELECT token, CAST(df AS BIGINT) AS df, round(idf, 9) AS idf FROM idf",
)
def fit_tfidf(spark, sf):
    return tfidf_fit(table(spark, sf, "documents"), "text").withColumn("idf", F.round("idf", 9))


@query(
    "v02_tfidf_transform",
    f"""WITH {_DOCUMENT_TF_SQL}, w AS (SELECT doc_id, token, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (token))
        SELECT doc_id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS weight FROM w""",
)
def transform_tfidf(spark, sf):
    docs = table(spark, sf, "documents")
    weights = tfidf_transform(docs, "doc_id", "text", tfidf_fit(docs, "text"))
    return weights.withColumn("weight", F.round("weight", 9))


@query(
    "v02_tfidf_other_settings",
    f"""WITH tf AS (SELECT doc_id, token, count(*) AS tf FROM
               (SELECT doc_id, {WORDS_SQL.format(text='text')} AS token FROM documents) t GROUP BY doc_id, token),
             n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
             idf AS (SELECT token, ln(max(n) / count(*)) + 1 AS idf FROM tf, n GROUP BY token
                     HAVING count(*) >= 5 AND count(*) <= 0.5e0 * max(n)),
             w AS (SELECT doc_id, token, tf * idf AS w FROM tf JOIN idf USING (token))
        SELECT doc_id, token, round(w / sum(abs(w)) OVER (PARTITION BY doc_id), 9) AS weight FROM w""",
)
def transform_other_settings(spark, sf):
    settings = TfidfSettings(min_df=5, max_df=0.5, smooth_idf=False, sublinear_tf=False, norm="l1")
    docs = table(spark, sf, "documents")
    weights = tfidf_transform(docs, "doc_id", "text", tfidf_fit(docs, "text", settings), settings)
    return weights.withColumn("weight", F.round("weight", 9))


# --- dense vectors ------------------------------------------------------------------------------------

# Unit vectors of the embeddings and of the titles of their tree.
_EMBEDDING_SQL = """
    e AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
    lab AS (SELECT DISTINCT label FROM embeddings),
    title AS (SELECT label, 'class ' || label AS title FROM lab UNION ALL SELECT label, 'family ' || (label // 2) FROM lab
              UNION ALL SELECT label, 'segment ' || (label // 4) FROM lab),
    pm AS (SELECT title, i, avg(CAST(x AS DOUBLE)) AS x FROM e JOIN title USING (label) GROUP BY title, i),
    proto AS (SELECT title, list(x ORDER BY i) AS v FROM pm GROUP BY title),
    target AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    classes AS (SELECT title, row_number() OVER (ORDER BY title) - 1 AS id, v FROM proto WHERE title LIKE 'class %'),
    scores AS (SELECT vec_id, id, title, round(list_cosine_similarity(target.v, classes.v), 9) AS score FROM target, classes)"""


def _class_prototypes(spark, sf):
    rows = inputs.prototypes(spark, sf).filter(F.col("title").startswith("class "))
    ids = G.class_table(rows, "title", "reference_id", "title")
    return rows.join(ids, "title").select("reference_id", "title", "vector")


def _targets(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))


@query(
    "v03_j5_cosine_top1",
    f"""WITH {_EMBEDDING_SQL}
        SELECT vec_id, reference_id, distance FROM
          (SELECT vec_id, id AS reference_id, round(1.0e0 - score, 9) + 0.0e0 AS distance,
                  row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, id) AS rn FROM scores) t WHERE rn = 1""",
)
def cosine_top1(spark, sf):
    return D.cosine_top1(_targets(spark, sf), _class_prototypes(spark, sf), "vec_id")


@query("v04_cosine_scores", f"WITH {_EMBEDDING_SQL} SELECT vec_id, id AS reference_id, score + 0.0e0 AS score FROM scores")
def cosine_scores(spark, sf):
    return D.cosine_scores(_targets(spark, sf), _class_prototypes(spark, sf), "vec_id")


_TOP_SQL = f"""WITH {_EMBEDDING_SQL},
        refs AS (SELECT title AS reference_id, v FROM proto),
        s AS (SELECT vec_id, reference_id, round(list_cosine_similarity(target.v, refs.v), 9) + 0.0e0 AS score FROM target, refs)
   SELECT vec_id {{id}} AS vec_id, reference_id, score, CAST(rn AS INTEGER) AS rank FROM
     (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, reference_id) AS rn FROM s) z WHERE rn <= 5"""


@query("v05_top_k_similar", _TOP_SQL.format(id=""))
def top_k_similar(spark, sf):
    """The five nearest titles of any level."""
    references = inputs.prototypes(spark, sf).select(F.col("title").alias("reference_id"), "vector")
    return D.top_k_similar(_targets(spark, sf), references, 5, "vec_id")


@query("v05_top_k_of_repeated_ids", _TOP_SQL.format(id="// 3"))
def top_k_of_repeated_ids(spark, sf):
    """Three rows share an id; references pass by in blocks of one."""
    references = inputs.prototypes(spark, sf).select(F.col("title").alias("reference_id"), "vector")
    targets = _targets(spark, sf).withColumn("vec_id", F.expr("vec_id div 3"))
    return D.top_k_similar(targets, references, 5, "vec_id", broadcast_cells=512)


@query(
    "a08_top_1_per_group",
    f"""WITH {_EMBEDDING_SQL}
        SELECT vec_id, reference_id, distance FROM
          (SELECT vec_id, id AS reference_id, round(1.0e0 - score, 9) + 0.0e0 AS distance,
                  row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, id) AS rn FROM scores) t WHERE rn = 1""",
)
def top_1_per_group(spark, sf):
    candidates = D.top_k_similar(_targets(spark, sf), _class_prototypes(spark, sf), 5, "vec_id")
    distance = (F.round(F.lit(1.0) - F.col("score"), 9) + 0.0).alias("distance")
    return G.top_1(candidates.select("vec_id", "reference_id", distance), "vec_id", "reference_id")


@query(
    "a08_top_1_of_candidates",
    """SELECT l_partkey, l_suppkey, distance FROM
         (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY distance, l_suppkey) AS rn FROM
            (SELECT l_partkey, l_suppkey, round(l_extendedprice / l_quantity, 9) AS distance FROM lineitem) c) t WHERE rn = 1""",
)
def top_1_of_candidates(spark, sf):
    """The cheapest supplier of each part, from all offers."""
    distance = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 9).alias("distance")
    return G.top_1(table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", distance), "l_partkey", "l_suppkey")


@query("v04_at_least", f"WITH {_EMBEDDING_SQL} SELECT vec_id, id AS reference_id, score + 0.0e0 AS score FROM scores WHERE score >= 0.25")
def cosine_scores_at_least(spark, sf):
    return D.cosine_scores(_targets(spark, sf), _class_prototypes(spark, sf), "vec_id", at_least=0.25)


@query(
    "v06_classify",
    f"""WITH {_EMBEDDING_SQL}
        SELECT vec_id, title AS label, score + 0.0e0 AS score FROM
          (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, id) AS rn FROM scores) t WHERE rn = 1""",
)
def classify_max(spark, sf):
    labels = _class_prototypes(spark, sf).select(F.col("reference_id").alias("row_idx"), F.col("title").alias("label"), "vector")
    return classify(_targets(spark, sf), labels, "vec_id")


@query(
    "v06_classify_lowest",
    f"""WITH {_EMBEDDING_SQL}
        SELECT vec_id, title AS label, score + 0.0e0 AS score FROM
          (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score, id) AS rn FROM scores) t WHERE rn = 1""",
)
def classify_min(spark, sf):
    labels = _class_prototypes(spark, sf).select(F.col("reference_id").alias("row_idx"), F.col("title").alias("label"), "vector")
    return classify(_targets(spark, sf), labels, "vec_id", is_max=False)


@query(
    "v06_classify_null_vectors",
    f"""WITH {_EMBEDDING_SQL}
        SELECT vec_id, CASE WHEN vec_id % 5 > 0 THEN title END AS label, CASE WHEN vec_id % 5 > 0 THEN score + 0.0e0 END AS score FROM
          (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, id) AS rn FROM scores) t WHERE rn = 1""",
)
def classify_null_vectors(spark, sf):
    labels = _class_prototypes(spark, sf).select(F.col("reference_id").alias("row_idx"), F.col("title").alias("label"), "vector")
    items = _targets(spark, sf).withColumn("vector", F.when(F.col("vec_id") % 5 > 0, F.col("vector")))
    return classify(items, labels, "vec_id")


@query(
    "v07_unpack_and_pack",
    "SELECT vec_id, label, embedding AS vector, embedding[1] AS first, embedding[64] AS last FROM embeddings",
)
def unpack_and_pack(spark, sf):
    wide = D.unpack_vector(table(spark, sf, "embeddings"), "embedding", 64)
    ends = wide.withColumn("first", F.col("embed_0")).withColumn("last", F.col("embed_63"))
    return D.pack_vector(ends)


# The hashed encoder: signed counts of 3-grams within words, scaled to length one, stored as single floats.
ENCODER_SQL = r"""
    spaced AS (SELECT t, regexp_replace(replace(trim(regexp_replace(lower(t), '\s+', ' ', 'g')), ' ', '  '), '^(.+)$', ' \1 ') AS s FROM texts),
    gram AS (SELECT t, unnest(list_transform(range(1, len(s) - 1), lambda i: substr(s, i, 3))) AS g FROM spaced),
    hash AS (SELECT t, CAST('0x' || substr(md5(g), 1, 15) AS BIGINT) AS h FROM gram WHERE NOT contains(g, '  ')),
    cell AS (SELECT t, h % 64 AS b, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END) AS c FROM hash GROUP BY t, h % 64),
    len AS (SELECT t, sqrt(CAST(sum(c * c) AS DOUBLE)) AS n FROM cell GROUP BY t),
    full_cell AS (SELECT texts.t, b.b, CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE coalesce(c, 0) / n END AS x
                  FROM texts CROSS JOIN (SELECT unnest(range(0, 64)) AS b) b LEFT JOIN cell ON cell.t = texts.t AND cell.b = b.b
                  LEFT JOIN len ON len.t = texts.t),
    enc AS (SELECT t, list(CAST(CAST(x AS FLOAT) AS DOUBLE) ORDER BY b) AS v FROM full_cell GROUP BY t)"""


@query(
    "v07_create_embeddings",
    f"""WITH texts AS (SELECT DISTINCT p_brand || ' ' || p_name AS t FROM part), {ENCODER_SQL}
        SELECT p_partkey AS id, {", ".join(f"round(v[{i + 1}], 6) + 0.0e0 AS embed_{i}" for i in range(64))}
        FROM part JOIN enc ON t = p_brand || ' ' || p_name""",
)
def create_embeddings(spark, sf):
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit(" "), "p_name").alias("text")
    )
    wide = D.create_embeddings(part, "text")
    return wide.select("id", *[(F.round(F.col(f"embed_{i}").cast("double"), 6) + 0.0).alias(f"embed_{i}") for i in range(64)])


@query(
    "v04_prompt",
    f"""WITH names AS (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY p_name),
             brands AS (SELECT p_brand, min(p_partkey) AS reference_id FROM part GROUP BY p_brand),
             texts AS (SELECT 'class of: ' || p_name AS t FROM names UNION SELECT p_brand AS t FROM brands), {ENCODER_SQL}
        SELECT id, reference_id, round(list_cosine_similarity(a.v, b.v), 9) + 0.0e0 AS score
        FROM names JOIN enc a ON a.t = 'class of: ' || p_name, brands JOIN enc b ON b.t = p_brand""",
)
def scores_with_a_prompt(spark, sf):
    """Distinct product names, with a prompt in front, against distinct brands."""
    part = table(spark, sf, "part")
    names = part.groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("id"))
    brands = part.groupBy(F.col("p_brand").alias("text")).agg(F.min("p_partkey").alias("reference_id"))
    return D.text_scores(names, brands, prompt="class of: ")


@query(
    "j01_result_table",
    f"""WITH {_EMBEDDING_SQL}
        SELECT vec_id AS product_id, p_name AS product_name, title AS predicted_class, 'class ' || label AS actual_class,
               round(1.0e0 - score, 9) + 0.0e0 AS distance, round(1.0e0 - (round(1.0e0 - score, 9) + 0.0e0), 9) AS similarity
        FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, id) AS rn FROM scores) t
        JOIN part ON p_partkey = vec_id JOIN embeddings USING (vec_id) WHERE rn = 1""",
)
def results(spark, sf):
    classes = _class_prototypes(spark, sf)
    scores = D.cosine_top1(_targets(spark, sf), classes, "vec_id").withColumnsRenamed(
        {"vec_id": "product_id", "reference_id": "class_id"}
    )
    products = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("translated_product_name"))
    names = classes.select(F.col("reference_id").alias("id"), F.col("title").alias("class_name"))
    actual = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("product_id"), F.concat(F.lit("class "), F.col("label").cast("string")).alias("class_name")
    )
    return result_table(scores, products, names, actual).withColumn("similarity", F.round("similarity", 9))


_LEVELS_SQL = f"""WITH {_EMBEDDING_SQL},
        first AS (SELECT label, min(vec_id) AS row_idx FROM embeddings GROUP BY label),
        tree AS (SELECT row_idx, 'segment ' || (label // 4) AS s, 'family ' || (label // 2) AS f, 'class ' || label AS c FROM first),
        seg AS (SELECT s, min(row_idx) AS o FROM tree GROUP BY s), fam AS (SELECT s, f, min(row_idx) AS o FROM tree GROUP BY s, f),
        cls AS (SELECT f, c, min(row_idx) AS o FROM tree GROUP BY f, c),
        p1 AS (SELECT vec_id, target.v, s, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(target.v, proto.v), 9) DESC, o) AS rn
               FROM target, seg JOIN proto ON title = s),
        p2 AS (SELECT vec_id, p1.v, p1.s, f, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(p1.v, proto.v), 9) DESC, o) AS rn
               FROM p1 JOIN fam ON fam.s = p1.s JOIN proto ON title = f WHERE p1.rn = 1),
        p3 AS (SELECT vec_id, p2.s, p2.f, c, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(p2.v, proto.v), 9) DESC, o) AS rn
               FROM p2 JOIN cls ON cls.f = p2.f JOIN proto ON title = c WHERE p2.rn = 1)
        SELECT {{id}} AS vec_id, s AS embed_segment, f AS embed_family, c AS embed_class FROM p3 WHERE rn = 1"""


@query("v08_hierarchical_classify", _LEVELS_SQL.format(id="vec_id"))
def classify_by_level(spark, sf):
    found = hierarchical_classify(
        _targets(spark, sf), inputs.embedding_taxonomy(spark, sf), inputs.prototypes(spark, sf), "vec_id"
    )
    return found.drop("vector")


@query("v08_classify_in_blocks", _LEVELS_SQL.format(id="CASE WHEN vec_id % 4 > 0 THEN vec_id // 4 END"))
def classify_in_blocks(spark, sf):
    """Ids that repeat or are null, and a taxonomy that passes by in blocks."""
    items = _targets(spark, sf).withColumn("vec_id", F.when(F.col("vec_id") % 4 > 0, F.expr("vec_id div 4")))
    tree, vectors = inputs.embedding_taxonomy(spark, sf), inputs.prototypes(spark, sf)
    return hierarchical_classify(items, tree, vectors, "vec_id", broadcast_cells=512).drop("vector")


# --- catalogue and linear classifier ------------------------------------------------------------------

# TF-IDF of the catalogue, and for every text t in texts the best catalogue row.
_CATALOGUE_SQL = f"""
    cat AS (SELECT min(p_partkey) AS row_idx, p_type, p_brand, p_name FROM part GROUP BY p_type, p_brand, p_name),
    ctf AS (SELECT row_idx, token, count(*) AS tf FROM
              (SELECT row_idx, {WORDS_SQL.format(text="p_type || ' ' || p_brand || ' ' || p_name")} AS token FROM cat) t GROUP BY row_idx, token),
    idf AS (SELECT token, ln((1 + (SELECT count(*) FROM cat)) / (1.0e0 + count(*))) + 1 AS idf FROM ctf GROUP BY token),
    cw AS (SELECT row_idx, token, (1 + ln(tf)) * idf AS w FROM ctf JOIN idf USING (token)),
    cv AS (SELECT row_idx, token, w / sqrt(sum(w * w) OVER (PARTITION BY row_idx)) AS w FROM cw),
    qtf AS (SELECT t, token, count(*) AS tf FROM (SELECT t, {WORDS_SQL.format(text='t')} AS token FROM texts) z GROUP BY t, token),
    qw AS (SELECT t, token, (1 + ln(tf)) * idf AS w FROM qtf JOIN idf USING (token)),
    qv AS (SELECT t, token, w / sqrt(sum(w * w) OVER (PARTITION BY t)) AS w FROM qw),
    sim AS (SELECT t, row_idx, round(sum(qv.w * cv.w), 9) AS score FROM qv JOIN cv USING (token) GROUP BY t, row_idx),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, row_idx) AS rn FROM sim) z WHERE rn = 1),
    hit AS (SELECT texts.t, coalesce(row_idx, (SELECT min(row_idx) FROM cat)) AS row_idx, coalesce(score, 0) AS score
            FROM texts LEFT JOIN top USING (t))"""

BRAND_SQL = f"""WITH texts AS (SELECT DISTINCT p_brand || ' ' || p_name AS t FROM part), {_CATALOGUE_SQL}
    SELECT part.p_partkey AS item_id, hit.t AS product_name, hit.row_idx AS brand_row, hit.score AS brand_score, hit.score > 0 AS brand_matched,
           cat.p_type AS brand_segment, cat.p_brand AS brand_family, cat.p_name AS brand_class
    FROM part JOIN hit ON t = part.p_brand || ' ' || part.p_name JOIN cat USING (row_idx)"""


@query("v09_brand_similarity", BRAND_SQL)
def brand_similarity(spark, sf):
    model = CatalogueModel.fit(inputs.catalogue(spark, sf))
    return model.predict(inputs.items(spark, sf).select("item_id", "product_name"), "product_name")


@query("v09_brand_similarity_in_blocks", BRAND_SQL)
def brand_similarity_in_blocks(spark, sf):
    """The catalogue passes by in blocks of 100 kB."""
    model = CatalogueModel.fit(inputs.catalogue(spark, sf))
    return model.predict(inputs.items(spark, sf).select("item_id", "product_name"), "product_name", block_bytes=100_000)


@query(
    "v09_brand_similarity_of_documents",
    f"""WITH texts AS (SELECT DISTINCT text AS t FROM documents), {_CATALOGUE_SQL}
        SELECT doc_id, hit.row_idx AS brand_row, hit.score AS brand_score, hit.score > 0 AS brand_matched,
               cat.p_type AS brand_segment, cat.p_brand AS brand_family, cat.p_name AS brand_class
        FROM documents JOIN hit ON t = text JOIN cat USING (row_idx)""",
)
def brand_similarity_of_documents(spark, sf):
    """Long texts, most of them without any word of the catalogue: these get its first row."""
    model = CatalogueModel.fit(inputs.catalogue(spark, sf))
    return model.predict(table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


@query("v12_save_and_load", BRAND_SQL)
def save_and_load(spark, sf):
    path = scratch_path(spark, "catalogue")
    CatalogueModel.fit(inputs.catalogue(spark, sf)).save(path)
    items = inputs.items(spark, sf).select("item_id", "product_name")
    return CatalogueModel.load(spark, path).predict(items, "product_name")


# Every text of an item names its class, so a fitted classifier must give each item its own class back.
_OWN_CLASS_SQL = """WITH gpc AS (SELECT p_partkey AS row_idx, nullif(p_type, 'PROMO') AS s, p_brand AS f, nullif(p_name, 'hot gear') AS c FROM part),
         l AS (SELECT c, min_by(s, row_idx) FILTER (WHERE s IS NOT NULL) AS s, min_by(f, row_idx) AS f FROM gpc WHERE c IS NOT NULL GROUP BY c)
    SELECT p_partkey AS item_id, p_name AS class, s AS clf_segment, f AS clf_family, p_name AS clf_class FROM part LEFT JOIN l ON c = p_name"""


@query("v10_v11_svm_of_items", _OWN_CLASS_SQL)
def svm_of_items(spark, sf):
    """Fit on all items, then predict them: class by margin, segment and family from the taxonomy."""
    items = inputs.items(spark, sf)
    model = LinearModel.fit(items, "product_name", "class", c=10.0)
    found = model.predict(items, "product_name", inputs.taxonomy(spark, sf))
    return found.select("item_id", "class", "clf_segment", "clf_family", "clf_class")


@query("v12_svm_save_and_load", _OWN_CLASS_SQL)
def svm_save_and_load(spark, sf):
    """Word pairs too; the loaded model knows its settings."""
    items, path = inputs.items(spark, sf), scratch_path(spark, "svm")
    LinearModel.fit(items, "product_name", "class", TfidfSettings(ngram_range=(1, 2)), c=10.0).save(path)
    found = LinearModel.load(spark, path).predict(items, "product_name", inputs.taxonomy(spark, sf))
    return found.select("item_id", "class", "clf_segment", "clf_family", "clf_class")


@query("v10_v11_svm_of_languages", "SELECT doc_id, lang, lang AS clf_class FROM documents")
def svm_of_languages(spark, sf):
    """Four classes of whole documents with balanced weights."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = LinearModel.fit(docs, "text", "lang", class_weight="balanced")
    return model.predict(docs, "text").select("doc_id", "lang", "clf_class")


@query(
    "v11_j2_label_lookup",
    """WITH gpc AS (SELECT p_partkey AS row_idx, nullif(p_type, 'PROMO') AS s, p_brand AS f, nullif(p_name, 'hot gear') AS c FROM part),
            l AS (SELECT c, min_by(s, row_idx) FILTER (WHERE s IS NOT NULL) AS s, min_by(f, row_idx) AS f FROM gpc WHERE c IS NOT NULL GROUP BY c)
       SELECT p_partkey AS item_id, p_name AS clf_class, s AS clf_segment, f AS clf_family FROM part LEFT JOIN l ON c = p_name""",
)
def lookup_labels(spark, sf):
    rows = inputs.items(spark, sf).select("item_id", F.col("class").alias("clf_class"))
    return label_lookup(rows, inputs.taxonomy(spark, sf), "clf_class")


# --- languages ----------------------------------------------------------------------------------------


_DETECTED_SQL = """WITH g AS (SELECT doc_id, lang, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || t[i + 1] || t[i + 2])) AS gram
                  FROM (SELECT doc_id, lang, string_split(lower(text), '') AS t FROM documents) d),
            c AS (SELECT lang, gram, count(*) AS c FROM g GROUP BY lang, gram),
            v AS (SELECT CAST(count(DISTINCT gram) AS DOUBLE) AS v FROM c),
            l AS (SELECT lang, ln(docs / CAST((SELECT count(*) FROM documents) AS DOUBLE)) AS prior, ln(1.0e0 / (total + v)) AS base
                  FROM (SELECT lang, sum(c) AS total FROM c GROUP BY lang) a JOIN (SELECT lang, count(*) AS docs FROM documents GROUP BY lang) b USING (lang), v),
            dg AS (SELECT doc_id, gram, count(*) AS k FROM g GROUP BY doc_id, gram),
            a AS (SELECT doc_id, c.lang, sum(k * ln(c + 1.0e0)) AS added FROM dg JOIN c USING (gram) GROUP BY doc_id, c.lang),
            s AS (SELECT d.doc_id, l.lang, round(prior + greatest(len(text) - 2, 0) * base + coalesce(added, 0), 6) AS score
                  FROM documents d CROSS JOIN l LEFT JOIN a ON a.doc_id = d.doc_id AND a.lang = l.lang)
       SELECT doc_id, lang, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS rn FROM s) z WHERE rn = 1"""


@query("x05_detect_language", _DETECTED_SQL)
def detect_language(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    found = LanguageModel.fit(docs, "text", "lang").detect(docs.drop("lang"), "text", score="score")
    return found.select("doc_id", "lang", "score")


@query(
    "x06_translate_non_english",
    """SELECT doc_id, CASE WHEN lang IN ('fr', 'de') THEN 'EN ' || md5(text) ELSE text END AS translated FROM documents""",
)
def translate(spark, sf):
    """The memory knows French and German texts; Spanish ones pass unchanged, also where a French one is equal."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    known = docs.filter(F.col("lang").isin("fr", "de")).select(F.col("text").alias("source"), "lang").distinct()
    memory = known.withColumn("translation", F.concat(F.lit("EN "), F.md5("source")))
    return translate_non_english(docs, "text", "lang", memory).select("doc_id", "translated")


@query("x06_translations_that_are_kept", "SELECT doc_id, CASE WHEN lang <> 'en' THEN 'EN ' || md5(text) ELSE text END AS translated, 2 AS n_batches FROM documents")
def translations_that_are_kept(spark, sf):
    """The memory starts with French texts, then gets all others, then the same batch again; nobody translates afterwards."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    memory = TranslationMemory(spark, scratch_path(spark, "translations"))
    translate = lambda texts: [f"EN {hashlib.md5(t.encode()).hexdigest()}" for t in texts]
    memory.add(docs.filter("lang = 'fr'"), "text", "lang", translate, "french")
    for _ in range(2):
        memory.add(docs, "text", "lang", translate, "others")
    found = translate_non_english(docs, "text", "lang", memory.table())
    return found.select("doc_id", "translated", F.lit(len(memory.batches())).alias("n_batches"))


# --- ensemble -----------------------------------------------------------------------------------------


def _ensemble_sql(items: str) -> str:
    """Votes ``w`` of the items ``it(item_id, product_name, t, clf_class)``; t is the text that is classified."""
    return f"""it AS ({items}),
    texts AS (SELECT DISTINCT t FROM it UNION SELECT p_type FROM part UNION SELECT p_brand FROM part UNION SELECT p_name FROM part),
    {_CATALOGUE_SQL}, {ENCODER_SQL},
    gpc AS (SELECT p_partkey AS row_idx, p_type AS s, p_brand AS f, p_name AS c FROM part),
    firsts AS (SELECT c, min_by(s, row_idx) AS s, min_by(f, row_idx) AS f FROM gpc GROUP BY c),
    q AS (SELECT DISTINCT it.t, v FROM it JOIN enc ON enc.t = it.t),
    seg AS (SELECT s, min(row_idx) AS o FROM gpc GROUP BY s), fam AS (SELECT s, f, min(row_idx) AS o FROM gpc GROUP BY s, f),
    cls AS (SELECT f, c, min(row_idx) AS o FROM gpc GROUP BY f, c),
    c1 AS (SELECT q.t, q.v, s, o, round(list_inner_product(q.v, e.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(e.v, e.v))), 9) AS x
           FROM q CROSS JOIN seg JOIN enc e ON e.t = s),
    p1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY x DESC, o) AS rn FROM c1) z WHERE rn = 1),
    c2 AS (SELECT p1.t, p1.v, p1.s, f, fam.o, round(list_inner_product(p1.v, e.v) / (sqrt(list_inner_product(p1.v, p1.v)) * sqrt(list_inner_product(e.v, e.v))), 9) AS x
           FROM p1 JOIN fam ON fam.s = p1.s JOIN enc e ON e.t = f),
    p2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY x DESC, o) AS rn FROM c2) z WHERE rn = 1),
    c3 AS (SELECT p2.t, p2.s, p2.f, c, cls.o, round(list_inner_product(p2.v, e.v) / (sqrt(list_inner_product(p2.v, p2.v)) * sqrt(list_inner_product(e.v, e.v))), 9) AS x
           FROM p2 JOIN cls ON cls.f = p2.f JOIN enc e ON e.t = c),
    p3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY x DESC, o) AS rn FROM c3) z WHERE rn = 1),
    votes AS (SELECT it.item_id, it.product_name, cat.p_type AS brand_segment, cat.p_brand AS brand_family, cat.p_name AS brand_class,
                     p3.s AS embed_segment, p3.f AS embed_family, p3.c AS embed_class,
                     k.s AS clf_segment, k.f AS clf_family, it.clf_class
              FROM it JOIN hit ON hit.t = it.t JOIN cat USING (row_idx) JOIN p3 ON p3.t = it.t JOIN firsts k ON k.c = it.clf_class),
    w AS (SELECT *, CASE WHEN embed_class = brand_class OR embed_class = clf_class THEN embed_class
                         WHEN brand_class = clf_class THEN brand_class ELSE clf_class END AS pred_class,
                 CASE WHEN embed_class = brand_class AND brand_class = clf_class THEN 3
                      WHEN embed_class = brand_class OR embed_class = clf_class OR brand_class = clf_class THEN 2 ELSE 1 END AS n FROM votes)"""


_ITEM_TEXT = "CASE WHEN p_type = 'PROMO' THEN p_name || ' imported ' || p_brand ELSE p_brand || ' ' || p_name END"
_FLAT_COLUMNS = """product_name, firsts.s AS pred_segment, firsts.f AS pred_family, pred_class, brand_segment, brand_family, brand_class,
               embed_segment, embed_family, embed_class, clf_segment, clf_family, clf_class, round(n / 3.0e0, 9) AS confidence_rate,
               CASE n WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' ELSE 'High' END AS confidence_level"""


def _third_voter(spark, sf):
    rows = inputs.voters(spark, sf).select(F.col("item_id").alias("__id"), "clf_class")
    taxonomy = inputs.full_taxonomy(spark, sf)
    # a left join: by an inner one Spark may broadcast the scored items, which it takes for as small as their packed file
    return lambda df: label_lookup(lookup_join(df, rows, "item_id", "__id").drop("__id"), taxonomy, "clf_class")


_VOTED_ITEMS = _ensemble_sql(f"""SELECT p_partkey AS item_id, p_brand || ' ' || p_name AS product_name, {_ITEM_TEXT} AS t,
        min_by(p_name, p_partkey) OVER (PARTITION BY p_type, p_size) AS clf_class FROM part""")


@query("v14_run_ensemble", f"WITH {_VOTED_ITEMS} SELECT item_id, {_FLAT_COLUMNS} FROM w JOIN firsts ON firsts.c = pred_class")
def run_ensemble(spark, sf):
    """Translation from memory, both similarity voters, and a lookup as third voter in place of the linear one."""
    taxonomy = inputs.full_taxonomy(spark, sf)
    ensemble = Ensemble(
        taxonomy,
        CatalogueModel.fit(inputs.catalogue(spark, sf)),
        _third_voter(spark, sf),
        title_vectors(taxonomy),
        memory=inputs.item_memory(spark, sf),
    )
    rows = ensemble.run(inputs.items(spark, sf).select("item_id", "product_name", "lang"), lang="lang")
    return rows.drop("lang").withColumn("confidence_rate", F.round("confidence_rate", 9))


_VOTED_BY_SVM = _ensemble_sql("SELECT p_partkey AS item_id, p_brand || ' ' || p_name AS product_name, p_brand || ' ' || p_name AS t, p_name AS clf_class FROM part")


@query("v12_ensemble_bundle", f"WITH {_VOTED_BY_SVM} SELECT {_FLAT_COLUMNS} FROM w JOIN firsts ON firsts.c = pred_class")
def ensemble_bundle(spark, sf):
    """The fitted ensemble saved, and loaded as it was."""
    items, folder = inputs.items(spark, sf), scratch_path(spark, "bundle")
    save_ensemble(*train(items, inputs.full_taxonomy(spark, sf), inputs.catalogue(spark, sf)), folder)
    rows = load_ensemble(spark, folder).flat(items.select("item_id", "product_name"))
    return rows.withColumn("confidence_rate", F.round("confidence_rate", 9))


_DOCUMENT_MEMORY = "SELECT text AS source, min(doc_id) AS k FROM documents WHERE lang IN ('fr', 'de') GROUP BY text"

_VOTED_DOCUMENTS = _ensemble_sql(f"""SELECT d.doc_id AS item_id, d.text AS product_name,
        CASE WHEN g.lang <> 'en' AND m.source IS NOT NULL THEN p.p_brand || ' ' || p.p_name ELSE d.text END AS t, c.p_name AS clf_class
        FROM documents d JOIN ({_DETECTED_SQL}) g USING (doc_id) LEFT JOIN ({_DOCUMENT_MEMORY}) m ON m.source = d.text
        LEFT JOIN part p ON p.p_partkey = m.k JOIN part c ON c.p_partkey = d.doc_id""")


@query(
    "v14_ensemble_of_documents",
    f"""WITH {_VOTED_DOCUMENTS} SELECT item_id, {_FLAT_COLUMNS.replace("product_name", "md5(product_name) AS product_md5", 1)}
        FROM w JOIN firsts ON firsts.c = pred_class""",
)
def ensemble_of_documents(spark, sf):
    """Languages are detected in the run, the memory has French and German texts, Spanish ones pass unchanged."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    part = table(spark, sf, "part").withColumnRenamed("p_partkey", "k")
    sources = docs.filter(F.col("lang").isin("fr", "de")).groupBy(F.col("text").alias("source")).agg(F.min("doc_id").alias("k"))
    memory = sources.join(part, "k").select("source", F.concat("p_brand", F.lit(" "), "p_name").alias("translation"))
    taxonomy = inputs.full_taxonomy(spark, sf)
    third = part.select(F.col("k").alias("__id"), F.col("p_name").alias("clf_class"))
    ensemble = Ensemble(
        taxonomy,
        CatalogueModel.fit(inputs.catalogue(spark, sf)),
        lambda df: label_lookup(df.join(third, df["item_id"] == F.col("__id")).drop("__id"), taxonomy, "clf_class"),
        title_vectors(taxonomy),
        memory=memory,
        languages=LanguageModel.fit(docs, "text", "lang"),
    )
    rows = ensemble.flat(docs.select(F.col("doc_id").alias("item_id"), F.col("text").alias("product_name")), keep=("item_id",))
    rows = rows.withColumns({"confidence_rate": F.round("confidence_rate", 9), "product_md5": F.md5("product_name")})
    return rows.drop("product_name")


@query("v14_ensemble_with_svm", f"WITH {_VOTED_BY_SVM} SELECT {_FLAT_COLUMNS} FROM w JOIN firsts ON firsts.c = pred_class")
def ensemble_with_svm(spark, sf):
    """All three classifiers fitted and voting: the fifteen output columns."""
    items = inputs.items(spark, sf)
    ensemble, _ = train(items, inputs.full_taxonomy(spark, sf), inputs.catalogue(spark, sf))
    rows = ensemble.flat(items.select("item_id", "product_name"))
    return rows.withColumn("confidence_rate", F.round("confidence_rate", 9))


@query("t10_classify_file", f"WITH {_VOTED_BY_SVM} SELECT DISTINCT {_FLAT_COLUMNS} FROM w JOIN firsts ON firsts.c = pred_class")
def classify_a_file(spark, sf):
    """The batch job: a CSV file of names goes in, a CSV file with a row per distinct name comes out."""
    items, source, target = inputs.items(spark, sf), *[f"{scratch_path(spark, name)}.csv" for name in ("names", "classified")]
    write_csv(items.select("product_name"), source)
    ensemble, _ = train(items, inputs.full_taxonomy(spark, sf), inputs.catalogue(spark, sf))
    classify_file(spark, ensemble, source, "product_name string", target)
    texts = ", ".join(f"{c} {'double' if c == 'confidence_rate' else 'string'}" for c in OUTPUT_COLUMNS)
    return read_table(spark, target, texts).withColumn("confidence_rate", F.round("confidence_rate", 9))


# The fitted linear classifier gives every held-out item its own class, since its text names it; this needs training
# items of every class, which the smallest table does not have.
_HELD_OUT = _ensemble_sql(f"""SELECT * FROM (SELECT p_partkey AS item_id, p_brand || ' ' || p_name AS product_name, {_ITEM_TEXT} AS t, p_name AS clf_class,
        row_number() OVER (ORDER BY md5('42:' || p_partkey)) <= ceil(0.2 * count(*) OVER ()) AS is_test FROM part) WHERE is_test""")


def _accuracy_sql(model: str, prefix: str) -> str:
    shares = [
        f"round(avg(CASE WHEN coalesce({prefix}_{level} = {true}, false) THEN 1.0e0 ELSE 0 END), 9) AS {level}_accuracy"
        for level, true in (("segment", "p_type"), ("family", "p_brand"), ("class", "p_name"))
    ]
    return f"SELECT '{model}' AS model, {', '.join(shares)} FROM v"


@query(
    "v15_train_and_test",
    f"""WITH {_HELD_OUT},
        v AS MATERIALIZED (SELECT w.*, firsts.s AS pred_segment, firsts.f AS pred_family, p_type, p_brand, p_name
                           FROM w JOIN firsts ON firsts.c = pred_class JOIN part ON p_partkey = item_id)
        {" UNION ALL ".join(_accuracy_sql(*m) for m in (("linear", "clf"), ("catalogue", "brand"), ("embedding", "embed"), ("ensemble", "pred")))}""",
)
def run_train_and_test(spark, sf):
    """Split, translate, fit, predict the held-out part, and accuracy per model and level."""
    from tierlabel.operators.tables import split_dataset

    split = split_dataset(inputs.items(spark, sf), "item_id")
    held_out, fitted_on = (split.filter(which).drop("is_test") for which in ("is_test", "NOT is_test"))
    taxonomy, catalogue = inputs.full_taxonomy(spark, sf), inputs.catalogue(spark, sf)
    memory = inputs.item_memory(spark, sf).persist()  # for the fitting and the scoring
    return train_and_test(fitted_on, held_out, taxonomy, catalogue, lang="lang", memory=memory)


# --- stream -------------------------------------------------------------------------------------------


@query("st1_score_stream", BRAND_SQL)
def stream_items(spark, sf):
    """Items arrive as files, are scored in micro-batches, and give the same rows as the batch query."""
    source, sink, state = (scratch_path(spark, name) for name in ("arriving", "scored", "state"))
    items = inputs.items(spark, sf).select("item_id", "product_name")
    items.repartition(4, "item_id").write.parquet(source)
    model = CatalogueModel.fit(inputs.catalogue(spark, sf))
    stream = score_stream(
        spark, source, items.schema, lambda batch: model.predict(batch, "product_name"), sink, state, files_per_batch=2
    )
    stream.awaitTermination()
    return spark.read.parquet(sink).drop("batch_id")
