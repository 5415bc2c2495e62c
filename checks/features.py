"""Text features, nearest neighbours and vector imputers."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from checks.fixtures import duck_with, fixture, query, table
from checks.impute import BLANK
from gapfill.operators.chained import ChainedRidgeImputer
from gapfill.operators.context import ContextEncoder
from gapfill.operators.knn import IterativeTextImputer, KnnTextImputer, embed_observed, knn_donors
from gapfill.operators.similar import nearest_text, topk_similar
from gapfill.operators.terms import counted
from gapfill.operators.tfidf import TfIdf, vocabulary
from gapfill.session import spread

CONTEXT = ("target_group", "framing", "intent", "toxicity_human", "predicted_author", "actual_method")


def grams_sql(source: str, key: str, text: str, min_len: int = 1, name: str = "grams") -> str:
    """CTEs ``<name>_t`` and ``<name>`` with one row per 1- and 2-gram occurrence."""
    word = "[\\p{L}\\p{N}_]+" if min_len == 1 else f"[\\p{{L}}\\p{{N}}_]{{{min_len},}}"
    return f"""{name}_t AS (SELECT {key} AS k, regexp_extract_all(lower({text}), '{word}') AS t FROM {source}),
      {name} AS (SELECT k, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term
                 FROM {name}_t)"""


def tfidf_sql(grams: str, n: str, max_features: int, name: str, min_df: int = 1) -> str:
    """CTE ``<name>(k, term, w)`` of unit-length weights over a selected vocabulary."""
    return f"""{name}_v AS (SELECT term, count(*) AS tf, count(DISTINCT k) AS df FROM {grams} GROUP BY term
        HAVING count(DISTINCT k) >= {min_df} ORDER BY tf DESC, term LIMIT {max_features}),
      {name}_w AS (SELECT k, term, count(*) * (ln((1 + {n}) / CAST(1 + any_value(df) AS DOUBLE)) + 1) AS w
        FROM {grams} JOIN {name}_v USING (term) GROUP BY k, term),
      {name} AS (SELECT k, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM {name}_w)"""


@query(
    "ngrams",
    f"WITH {grams_sql('documents', 'doc_id', 'text')} SELECT k AS doc_id, term, count(*) AS n FROM grams GROUP BY ALL",
)
def ngrams_of(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    found = docs.select("doc_id", counted("text").alias("t"))
    found = found.select("doc_id", F.explode(F.arrays_zip("t.terms", "t.tf")).alias("t"))
    return found.select("doc_id", F.col("t.terms").alias("term"), F.col("t.tf").alias("n"))


@query(
    "vocabulary",
    f"""WITH {grams_sql('documents', 'doc_id', 'text')} SELECT term, count(*) AS tf, count(DISTINCT k) AS df FROM grams
        GROUP BY term HAVING count(DISTINCT k) >= 2 ORDER BY tf DESC, term LIMIT 3000""",
)
def vocabulary_of(spark, sf):
    return vocabulary(table(spark, sf, "documents"), "text", 3000, min_df=2)


@query(
    "tfidf",
    f"""WITH {grams_sql('documents', 'doc_id', 'text')}, {tfidf_sql('grams', '(SELECT count(*) FROM documents)', 3000, 'weights')}
        SELECT k AS doc_id, term, round(w, 6) AS weight FROM weights""",
)
def tfidf_of(spark, sf):
    docs = table(spark, sf, "documents")
    model = TfIdf("text", 3000).fit(docs)
    return model.weights(docs, "doc_id").withColumn("weight", F.round("weight", 6))


@query("svd_embed")
def svd_embed(spark, sf):
    return embed_observed(table(spark, sf, "documents"), "doc_id", "text", 3000, 256, 42)


def _one_hot(c: str) -> str:
    return f"""SELECT row_id, '{c}' || '=' || coalesce({c}, '') AS dim, CAST(1 AS DOUBLE) AS value FROM doc_holes"""


@query(
    "encode_context",
    f"""{duck_with('doc_holes')} SELECT row_id, 'toxicity_human' AS dim, toxicity_human AS value FROM doc_holes
        UNION ALL SELECT row_id, 'intent', intent FROM doc_holes
        UNION ALL {_one_hot('target_group')} UNION ALL {_one_hot('predicted_author')} UNION ALL {_one_hot('actual_method')}
        UNION ALL SELECT row_id, 'framing=' || coalesce(framing, '<null>'), CAST(1 AS DOUBLE) FROM doc_holes""",
)
def encode_context(spark, sf):
    df = fixture(spark, sf, "doc_holes")
    model = ContextEncoder("text", CONTEXT).fit(df)
    names = list(model.numeric)
    names += [f"{c}={'<null>' if v is None else v}" for c, values in model.categories.items() for v in values]
    dims = df.select("row_id", F.posexplode(model.encode()).alias("i", "value")).filter(
        (F.col("i") < len(model.numeric)) | (F.col("value") > 0)
    )
    return dims.select("row_id", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1).alias("dim"), "value")


_DIFF = " + ".join(
    f"2 * CAST((b.{c} IS DISTINCT FROM o.{c}) AS INT)" for c in ("target_group", "framing", "predicted_author", "actual_method")
)
_DONORS = f"""pairs AS (SELECT b.row_id, o.row_id AS donor, round(sqrt({_DIFF} + (b.intent - o.intent) ** 2
      + (b.toxicity_human - o.toxicity_human) ** 2), 9) AS distance
    FROM (SELECT * FROM doc_holes WHERE {BLANK}) b CROSS JOIN (SELECT * FROM doc_holes WHERE NOT {BLANK}) o),
  near AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY distance, donor) AS rank FROM pairs QUALIFY rank <= 5)"""


@query(
    "knn_donors",
    f"""{duck_with('doc_holes')}, {_DONORS} SELECT row_id, donor, rank, round(distance, 6) AS distance,
        round(CASE WHEN min(distance) OVER (PARTITION BY row_id) = 0 THEN CAST(CAST(distance = 0 AS INT) AS DOUBLE)
        ELSE 1 / distance END, 6) AS weight FROM near""",
)
def knn_donors_of(spark, sf):
    found = knn_donors(fixture(spark, sf, "doc_holes"), "row_id", "text", CONTEXT)
    return found.withColumns({c: F.round(c, 6) for c in ("distance", "weight")})


@query("knn_impute")
def knn_impute(spark, sf):
    df = fixture(spark, sf, "doc_holes")
    return KnnTextImputer("row_id", "text", CONTEXT).fit(df).transform(df).select("row_id", "text", "was_filled")


@query(
    "knn_impute_terms",
    f"""{duck_with('doc_holes')}, {_DONORS},
        weighted AS (SELECT row_id, donor, CASE WHEN min(distance) OVER (PARTITION BY row_id) = 0 THEN CAST(distance = 0 AS INT)
          ELSE 1 / distance END AS weight FROM near),
        observed AS (SELECT row_id, text FROM doc_holes WHERE NOT {BLANK}), {grams_sql('observed', 'row_id', 'text')},
        {tfidf_sql('grams', '(SELECT count(*) FROM observed)', 200, 'tw')},
        means AS (SELECT row_id, term, sum(weight * w) AS m FROM weighted JOIN tw ON k = donor GROUP BY row_id, term),
        norms AS (SELECT row_id, sqrt(sum(m * m)) AS l FROM means GROUP BY row_id),
        scored AS (SELECT means.row_id, k, round(sum(m * w) / any_value(l), 9) AS score FROM means JOIN norms ON norms.row_id = means.row_id
          JOIN tw USING (term) GROUP BY means.row_id, k),
        best AS (SELECT row_id, k FROM scored QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, k) = 1)
        SELECT d.row_id, coalesce(o.text, d.text) AS text, {BLANK.replace('text', 'd.text')} AS was_filled
        FROM doc_holes d LEFT JOIN best ON best.row_id = d.row_id LEFT JOIN observed o ON o.row_id = best.k""",
)
def knn_impute_terms(spark, sf):
    """With no more terms than components the embedding is the TF-IDF vector itself, which SQL can follow to the text."""
    df = fixture(spark, sf, "doc_holes")
    model = KnnTextImputer("row_id", "text", CONTEXT, max_features=200).fit(df)
    return model.transform(df).select("row_id", "text", "was_filled")


@query(
    "embedding_neighbours",
    """WITH dims AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
      unit AS (SELECT vec_id, i, CAST(x AS DOUBLE) / sqrt(sum(CAST(x AS DOUBLE) * x) OVER (PARTITION BY vec_id)) AS x FROM dims),
      scored AS (SELECT a.vec_id, b.vec_id AS match, round(sum(a.x * b.x), 9) AS score FROM unit a JOIN unit b USING (i) GROUP BY ALL)
      SELECT vec_id, match, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, match) AS rank, round(score, 6) AS score
      FROM scored QUALIFY rank <= 5""",
)
def embedding_neighbours(spark, sf):
    """Every vector against all, by clusters and bounds."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    found = topk_similar(vectors, vectors, 5, pruned=True)
    return found.select(F.col("query").alias("vec_id"), "match", "rank", F.round("score", 6).alias("score"))


@query("iterative_text_impute")
def iterative_text_impute(spark, sf):
    df = fixture(spark, sf, "doc_holes")
    model = IterativeTextImputer("row_id", "text", CONTEXT).fit(df)
    return model.transform(df).select("row_id", "text", "was_filled")


@query("iterative_impute")
def iterative_impute(spark, sf):
    df = fixture(spark, sf, "ev_numeric")
    return ChainedRidgeImputer(["value", "score", "bucket"]).fit(df).transform(df)


@query(
    "nearest_text",
    """WITH dims AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
      centre AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM dims GROUP BY ALL),
      cnorm AS (SELECT label, sqrt(sum(x * x)) AS l FROM centre GROUP BY label),
      vnorm AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * x)) AS l FROM dims GROUP BY vec_id),
      dot AS (SELECT c.label, d.vec_id, sum(c.x * CAST(d.x AS DOUBLE)) AS s FROM centre c JOIN dims d USING (i) GROUP BY ALL),
      scored AS (SELECT dot.label, vec_id, round(s / cnorm.l / vnorm.l, 9) AS score FROM dot
        JOIN cnorm ON cnorm.label = dot.label JOIN vnorm USING (vec_id))
      SELECT label, vec_id AS match, round(score, 6) AS score, 'vector ' || vec_id AS text FROM scored
      QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1""",
)
def nearest_text_of(spark, sf):
    vectors = table(spark, sf, "embeddings")
    centres = vectors.groupBy("label").agg(vector_to_array(Summarizer.mean(array_to_vector("embedding"))).alias("embedding"))
    corpus = vectors.withColumn("text", F.concat(F.lit("vector "), F.col("vec_id").cast("string")))
    return nearest_text(centres, corpus, "label", "vec_id").withColumn("score", F.round("score", 6))

