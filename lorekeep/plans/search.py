"""Vector search, people and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import beliefs as B
from ..operators import vectors as V
from ..sources.views import BELIEFS, NEWEST, REPLACES, beliefs, newest, replaces, table
from .catalog import query

_Q = "(select list_transform(embedding, lambda x: cast(x as double)) from embeddings where vec_id = 0)"
_MEAN = """v as (select a.vec_id, list_transform(a.embedding, lambda x: cast(x as double)) as e, list_transform(p.embedding, lambda x: cast(x as double)) as p, list_transform(n.embedding, lambda x: cast(x as double)) as n
  from embeddings a left join embeddings p on p.vec_id = a.vec_id - 1 left join embeddings n on n.vec_id = a.vec_id + 1),
t as (select vec_id, list_transform(generate_series(1, len(e)), lambda i: e[i] + coalesce(p[i], 0) + coalesce(n[i], 0)) as t from v),
win as (select vec_id, list_transform(t, lambda x: x / sqrt(list_dot_product(t, t))) as e from t)"""


@query(f"""select vec_id, round(list_dot_product(list_transform(embedding, lambda x: cast(x as double)), {_Q}), 6) as sim from embeddings order by sim desc, vec_id limit 20""")
def knn_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return V.top_k(vectors, V.vector_of(vectors, "vec_id", 0), 20)


def _hybrid(asked: bool) -> str:
    return f"""with {_MEAN}, s as (select w.vec_id, round(list_dot_product(w.e, {_Q}), 6) as win, round(list_dot_product(list_transform(o.embedding, lambda x: cast(x as double)), {_Q}), 6) as obs, o.label = 3 as q
  from win w join embeddings o using (vec_id)),
c as ((select vec_id from s order by win desc, vec_id limit 30) union (select vec_id from s order by obs desc, vec_id limit 30))
select vec_id, win, obs, round((0.75 * win + 0.25 * obs) * case when q and {str(asked).lower()} then 0.85 else 1.0 end, 6) as score from s join c using (vec_id) order by score desc, vec_id limit 10"""


def _fused(spark, sf_dir, asked):
    vectors = table(spark, sf_dir, "embeddings")
    questions = vectors.select("vec_id", (F.col("label") == 3).alias("is_question"))
    return V.hybrid(V.neighbour_mean(vectors), vectors, questions, V.vector_of(vectors, "vec_id", 0), 10, asked)


@query(_hybrid(False))
def hybrid_search(spark, sf_dir):
    return _fused(spark, sf_dir, False)


@query(_hybrid(True))
def question_penalty(spark, sf_dir):
    return _fused(spark, sf_dir, True)


def _belief_sql(post: bool) -> str:
    live = "id not in (select dst_id from replaces)"
    return f"""with {BELIEFS}, {REPLACES},
b as (select id, weight * pow(0.5, greatest({NEWEST} - formed_at, 0) / 86400 / 30.0) as w, round(list_dot_product(list_transform(embedding, lambda x: cast(x as double)), {_Q}), 6) as sim from beliefs join embeddings on vec_id = id),
c as (select * from b {"" if post else f"where {live}"} order by sim desc, id limit 25)
select id, sim, round(sim * (0.5 + least(w, 1.0) / 2), 6) as score from c {f"where {live}" if post else ""}"""


def _beliefs(spark, sf_dir, post):
    vectors = table(spark, sf_dir, "embeddings")
    b = beliefs(spark, sf_dir)
    held = b.withColumn("weight_now", B.decayed(F.col("weight"), F.col("formed_at"), F.lit(newest(b)))).join(vectors.select(F.col("vec_id").alias("id"), "embedding"), "id")
    return V.belief_search(held, replaces(b).select(F.col("dst_id").alias("id")), V.vector_of(vectors, "vec_id", 0), 25, post)


@query(_belief_sql(False))
def belief_search_decayed(spark, sf_dir):
    return _beliefs(spark, sf_dir, False)


@query(_belief_sql(True))
def belief_search_postfilter(spark, sf_dir):
    return _beliefs(spark, sf_dir, True)


@query("""with d as (select label, unnest(generate_series(1, len(embedding))) as i, unnest(embedding) as x from embeddings),
m as (select label, i, avg(cast(x as double)) as m from d group by label, i),
v as (select label, list(m order by i) as v from m group by label)
select label, list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 6)) as centroid from v""")
def centroid_vectors(spark, sf_dir):
    return V.centroids(table(spark, sf_dir, "embeddings"))


def _enrolled(vectors):
    """The first five vectors of each label as its person's prints, the others as probes."""
    rank = F.expr("row_number() over (partition by label order by vec_id)")
    rows = vectors.withColumn("k", rank)
    return rows.where("k <= 5").select(F.col("label").alias("person"), "embedding"), rows.where("k > 5").select("vec_id", "embedding")


@query("""with e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e, row_number() over (partition by label order by vec_id) as k from embeddings),
d as (select p.vec_id, a.label as person, min(round(1 - list_dot_product(p.e, a.e), 6)) as d from e p, e a where p.k > 5 and a.k <= 5 group by all),
r as (select *, row_number() over (partition by vec_id order by d, person) as k from d),
t as (select a.vec_id, a.person, a.d as distance, round(b.d - a.d, 6) as margin from r a left join r b on a.vec_id = b.vec_id and b.k = 2 where a.k = 1),
x as (select *, case when distance <= 0.40 and coalesce(margin, 9) >= 0.10 then 'confident' when distance <= 0.70 then 'match' else 'unknown' end as decision from t)
select *, case when decision = 'unknown' then 0.0 else round(least(greatest((0.70 - distance) / 0.30, 0), 1) * least(greatest(coalesce(margin, 9) / 0.20, 0), 1), 6) end as confidence from x""")
def match_people(spark, sf_dir):
    prints, probes = _enrolled(table(spark, sf_dir, "embeddings"))
    return V.match_people(probes, prints)


@query("""with e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
d as (select a.label, 1 - list_dot_product(a.e, b.e) as d from e a join e b on a.label = b.label and a.vec_id < b.vec_id)
select label, count(*) as pairs, round(quantile_cont(d, 0.1), 6) as p10, round(quantile_cont(d, 0.5), 6) as p50, round(quantile_cont(d, 0.9), 6) as p90, round(avg(case when d > 0.9 then 1.0 else 0.0 end), 6) as far_share from d group by label""")
def pair_distance_percentiles(spark, sf_dir):
    return V.pair_distances(table(spark, sf_dir, "embeddings"))


@query("""with r as (select vec_id as pos, vec_id // 50 as run, label, lag(label) over w as p, lead(label) over w as n from embeddings window w as (partition by vec_id // 50 order by vec_id))
select pos, run, label, case when p is null or n is null then label when p = label or label = n then label when p = n then p else least(p, label, n) end as smooth from r""")
def smooth_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id as pos", "vec_id div 50 as run", "label")
    return V.same_label_smoothed(rows)


@query(f"""with s as (select label, round(list_dot_product(list_transform(embedding, lambda x: cast(x as double)), {_Q}), 6) as sim, vec_id from embeddings),
r as (select label, row_number() over (order by sim desc, vec_id) as k from s)
select label, count(*) as rows, round(avg(case when k <= 100 then 1.0 else 0.0 end), 6) as recall from r group by label""")
def recall_at_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    hits = V.top_k(vectors, V.vector_of(vectors, "vec_id", 0), 100).select("vec_id", F.lit(1.0).alias("hit"))
    return vectors.select("vec_id", "label").join(F.broadcast(hits), "vec_id", "left").groupBy("label").agg(F.count("*").alias("rows"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("recall"))
