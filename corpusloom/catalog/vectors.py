"""Vector queries."""

from __future__ import annotations

from corpusloom.catalog.base import F, query, table
from corpusloom.operators import vectors
from corpusloom.plans.stages import checkpointed

_COS = "round(list_inner_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_inner_product(a.embedding::double[], a.embedding::double[]) * list_inner_product(b.embedding::double[], b.embedding::double[])), 5)"


@query(f"with q as (select vec_id, embedding from embeddings where vec_id % 100 = 0), s as (select a.vec_id as query, b.vec_id as key, {_COS} as similarity, list_inner_product(a.embedding::double[], b.embedding::double[]) as raw from q a join embeddings b on a.vec_id <> b.vec_id) select query, key, similarity from s qualify row_number() over (partition by query order by raw desc, key) <= 10")
def vec_topk(spark, d):
    """Ten most similar vectors of each query vector, exact (V01, O05, J15); the queries are the ids divisible by 100, against all rows."""
    e = table(spark, d, "embeddings")
    return vectors.top_k(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", 64, 10).select("query", "key", F.round("similarity", 5).alias("similarity"))


@query(f"with q as (select vec_id, embedding from embeddings where vec_id % 100 = 0), s as (select a.vec_id as query, b.vec_id as key, {_COS} as similarity, list_inner_product(a.embedding::double[], b.embedding::double[]) as raw from q a join embeddings b on a.vec_id <> b.vec_id) select query, key, similarity from s qualify row_number() over (partition by query order by raw desc, key) <= 10")
def vec_index_topk(spark, d):
    """The same over the index (V02, O06), all its cells asked, which makes it exact; fewer probes are what the index is for."""
    e = table(spark, d, "embeddings")
    centres = vectors.fitted_cells(e, "vec_id", "embedding", 64)
    index = checkpointed(vectors.indexed(e, "vec_id", "embedding", 64, centres))
    return vectors.index_top_k(index, centres, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", 64, 10, probes=len(centres)).select("query", "key", F.round("similarity", 5).alias("similarity"))


@query(f"with q as (select vec_id, embedding from embeddings where vec_id % 100 = 0) select a.vec_id as query, b.vec_id as key, {_COS} as similarity from q a join embeddings b on a.vec_id <> b.vec_id where list_inner_product(a.embedding::double[], b.embedding::double[]) >= 0.3")
def vec_near_duplicates(spark, d):
    """All neighbours of the query vectors within a similarity."""
    e = table(spark, d, "embeddings")
    return vectors.within(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", 64, 0.3).select("query", "key", F.round("similarity", 5).alias("similarity"))


@query("select doc_id, sentence_id, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) as norm, abs(sqrt(list_inner_product(embedding::double[], embedding::double[])) - 1) <= 1e-3 as is_unit from ccf_sentence_embeddings where embedding is not null group by all")
def vec_norm_check(spark, d):
    """Norms, and whether they are 1 within 1e-3."""
    n = vectors.norms(table(spark, d, "ccf_sentence_embeddings").filter("embedding is not null"), "embedding")
    return n.select("doc_id", "sentence_id", F.round("norm", 6).alias("norm"), (F.abs(F.col("norm") - 1) <= 1e-3).alias("is_unit")).distinct()


@query("select case when sentence_id = 0 then 'title' else 'unit' end as kind, count(distinct (doc_id, sentence_id)) as n, count(distinct doc_id) as n_articles from ccf_sentence_embeddings where len(embedding) = 96 group by 1")
def title_vectors(spark, d):
    """Titles under sentence 0 beside units."""
    e = table(spark, d, "ccf_sentence_embeddings").filter("size(embedding) = 96")
    return e.groupBy(F.when(F.col("sentence_id") == 0, "title").otherwise("unit").alias("kind")).agg(F.countDistinct("doc_id", "sentence_id").alias("n"), F.countDistinct("doc_id").alias("n_articles"))


@query("with x as (select label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from embeddings) select label, i::int - 1 as i, round(avg(v), 6) as mean from x group by 1, 2")
def vec_label_centroid(spark, d):
    """Mean vector of each label, one row per component."""
    return table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))
