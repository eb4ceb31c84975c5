"""Pitch tracks, spans, sentences, speakers of recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merging as M
from ..operators import signals as S
from ..operators import speakers as K
from ..sources.views import WORDS, table, words
from .catalog import query


@query(f"""with {WORDS}, t as (select speaker, count(pitch) as n, quantile_cont(pitch, 0.05) * 0.75 as lo, quantile_cont(pitch, 0.95) * 1.5 as hi from words group by speaker)
select speaker, n, round(case when n >= 100 and greatest(lo, 40) < least(hi, 600) then greatest(lo, 40) else 60 end, 6) as floor, round(case when n >= 100 and greatest(lo, 40) < least(hi, 600) then least(hi, 600) else 300 end, 6) as ceiling from t""")
def pitch_range(spark, sf_dir):
    return S.pitch_range(words(spark, sf_dir), "speaker", "pitch")


@query(f"""with recursive {WORDS}, v as (select speaker, sentence, list(value) as v, 0 as k from words group by speaker, sentence union all
  select speaker, sentence, list_filter(v, lambda x: x <= 2 * list_median(v)), k + 1 from v where k < 5)
select speaker, sentence, len(v) as kept, round(list_sum(v), 4) as total from v where k = 5""")
def octave_rejection(spark, sf_dir):
    v = words(spark, sf_dir).groupBy("speaker", "sentence").agg(F.collect_list("value").alias("v"))
    kept = v.withColumn("v", S.without_octave_errors(F.col("v")))
    return kept.select("speaker", "sentence", F.size("v").cast("long").alias("kept"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


def _split_tokens(documents):
    t = documents.select(F.explode(F.split("text", " ")).alias("token")).distinct()
    return t.select("token", S.split_punctuation(F.col("token")).alias("s")).select("token", "s.word", "s.punct")


@query("""with t as (select distinct unnest(string_split(text, ' ')) as token from documents), s as (select token, regexp_extract(token, '([.,!?;:…]+)$', 1) as p from t)
select token, case when token = p then token else substr(token, 1, len(token) - len(p)) end as word, case when token = p then '' else p end as punct from s""")
def split_punctuation(spark, sf_dir):
    """The tokens of all documents."""
    return _split_tokens(table(spark, sf_dir, "documents"))


@query(f"""with {WORDS}, w as (select id, speaker, "end" - 900 as s, "end" as e, lag("end") over (partition by speaker order by "end", id) as p from words)
select id, round(case when p > s then least(p, e) else s end, 3) as s, round(e, 3) as e from w""")
def trim_spans(spark, sf_dir):
    """Spans of 15 minutes cut by the silence that the word before leaves behind it."""
    w = words(spark, sf_dir).selectExpr("id", "end - 900 as s", "end as e", "lag(end) over (partition by speaker order by end, id) as p")
    silence = F.when(F.col("p").isNotNull(), F.array(F.struct(F.lit(0.0).alias("t0"), F.col("p").alias("t1")))).otherwise(F.array().cast("array<struct<t0:double,t1:double>>"))
    cut = w.select("id", "e", S.trimmed(F.col("s"), F.col("e"), F.filter(silence, lambda q: q["t1"] < F.col("e"))).alias("x"))
    return cut.select("id", F.round("x.s", 3).alias("s"), F.round("x.e", 3).alias("e"))


@query(None)
def noise_and_speech(spark, sf_dir):
    return S.noise_and_speech(words(spark, sf_dir), "speaker", "loud")


@query(None)
def sentence_assignment(spark, sf_dir):
    """Words of a user with their sentences, an hour of the table taken as a second of the recording."""
    w = words(spark, sf_dir).selectExpr("speaker as file", "id", "id % 2 as speaker", "end / 3600 as start", "end / 3600 + 0.2 as end", "if(id % 9 = 0, '.', '') as punct", "pitch")
    return S.sentences(w).select("file", "id", "sentence")


@query(None)
def diarize_windows(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").selectExpr("vec_id div 100 as file", "vec_id as at", "embedding")
    return K.diarized(v, 0.85)


@query(None)
def clusters_merged(spark, sf_dir):
    """Clusters of every file, a third of a label's vectors each, merged by their centroids, with the trace of the merges."""
    v = table(spark, sf_dir, "embeddings").selectExpr("vec_id div 100 as file", "label * 3L + vec_id % 3 as label", "embedding")
    return M.merge_centroids(v, 0.9)


@query(None)
def learned_prints(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").selectExpr("label as person", "embedding", "0.2D + (vec_id % 10) / 10 as strength")
    return K.learned(v).select("person", F.round("strength", 6).alias("strength"))


@query("select conv_id, turn, row_number() over (partition by role order by md5(cast(conv_id as varchar) || ':' || cast(turn as varchar)), conv_id, turn) as place from conversations qualify place <= 20")
def seeded_sample(spark, sf_dir):
    """Twenty turns of each role in an order that a hash decides."""
    from pyspark.sql import Window as W

    order = W.partitionBy("role").orderBy(F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), "conv_id", "turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(order).cast("long").alias("place")).where("place <= 20")
