"""From captured speech to stored baselines, prints and vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import capture as C
from ..operators import prosody as P
from ..operators import store as S
from ..sources.views import WORDS, table, words
from .catalog import query

_STATS = f"""{WORDS}, s as (select speaker, count(*) as n, avg(loud) as mean, stddev_pop(loud) as sd from words where not suspect group by speaker)"""


def _stats(spark, sf_dir):
    good = words(spark, sf_dir).where("not suspect").groupBy("speaker").agg(*P.sums(F.col("loud"), "loud"))
    mean, sd = P.mean_sd(F.col("loud_n"), F.col("loud_s"), F.col("loud_q"))
    return good.select("speaker", F.col("loud_n").alias("n"), mean.alias("mean"), sd.alias("sd"))


@query(f"with {_STATS} select speaker, n, round(mean, 5) as mean from s")
def baselines_saved(spark, sf_dir):
    """Every speaker's baseline, saved as JSON under its settings and loaded again under the same."""
    path = f"{S.shared_folder(spark)}/baselines-{uuid.uuid4().hex}"
    C.save_baselines(_stats(spark, sf_dir), path, {"cue": "loud", "version": "3"})
    return C.load_baselines(spark, path, {"version": "3", "cue": "loud"}).select("speaker", "n", F.round("mean", 5).alias("mean"))


@query(f"with {_STATS}, k as (select c_custkey as speaker from customer) select k.speaker, coalesce(n, 0) as n, round(coalesce(mean, 0), 5) as mean, n is null as empty from k left join s on s.speaker = k.speaker")
def baselines_or_empty(spark, sf_dir):
    """The baseline of each customer as a speaker; of those that never spoke the empty one."""
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("speaker"))
    return C.or_empty(known, _stats(spark, sf_dir)).select("speaker", "n", F.round("mean", 5).alias("mean"), "empty")


@query(f"""with {WORDS}, r as (select *, row_number() over (partition by speaker, sentence order by "end" desc, id desc) as k from words),
p as (select speaker, sentence, quantile_cont(pitch, 0.5) as before from r where k > 1 group by 1, 2)
select r.speaker, r.sentence, r.id, r.id % 9 = 0 as marked, coalesce(pitch < 0.95 * before, false) as fell from r left join p on p.speaker = r.speaker and p.sentence = r.sentence where k = 1""")
def sentences_finished(spark, sf_dir):
    """Of each sentence's last word whether a mark ends it and whether the pitch has fallen below the words before it."""
    w = words(spark, sf_dir).withColumn("punct", F.expr("if(id % 9 = 0, '.', '')"))
    return C.finished(w, ["speaker", "sentence"])


@query("""with d as (select event_type as provider, max(cast(ts as date)) as today, count(*) filter (cast(ts as date) = (select max(cast(ts as date)) from events)) as calls, max_by(value > 100, (ts, event_id)) as failed from events group by 1)
select provider, case when provider = 'signup' then 'no key' when calls >= 60 then 'out of budget' when failed then 'failing' else 'available' end as state, calls from d""")
def providers_surveyed(spark, sf_dir):
    """Which providers could be asked, in the order of what stands against them."""
    e = table(spark, sf_dir, "events")
    today = e.agg(F.max(F.to_date("ts"))).first()[0]
    calls = e.select(F.col("event_type").alias("provider"), (F.to_date("ts") == F.lit(today)).alias("today"), (F.col("value") > 100).alias("failed"), F.struct("ts", "event_id").alias("at"))
    return C.surveyed(calls, ["view", "click", "purchase", "error"], 60)


@query("""with v as (select label as person, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings where vec_id % 4 <> 0), m as (select person, pos, avg(v[pos]) as x from (select *, unnest(generate_series(1, 64)) as pos from v) group by 1, 2),
n as (select person, sqrt(sum(x * x)) as n from m group by 1), c as (select person, count(*) as windows from v group by 1)
select person, windows, round(x / n, 6) as first from m join n using (person) join c using (person) where pos = 1""")
def enrolment_prints(spark, sf_dir):
    """Everyone's print from the usable three quarters of their windows."""
    v = table(spark, sf_dir, "embeddings").withColumn("usable", F.expr("vec_id % 4 != 0"))
    return C.enrolled(v, "label").select(F.col("label").alias("person"), "windows", F.col("print")[0].alias("first"))


@query("""with w as (select doc_id, unnest(list_concat(['passage:'], regexp_extract_all(lower(text), '[a-z0-9]+'))) as w from documents), d as (select doc_id, cast('0x' || substr(md5(w), 1, 8) as bigint) % 64 as dim, count(*) as n from w group by 1, 2)
select doc_id, count(*) as dims, round(max(n) / sqrt(sum(n * n)), 6) as top, round(coalesce(max(n) filter (dim = 7), 0) / sqrt(sum(n * n)), 6) as seventh from d group by doc_id""")
def texts_embedded(spark, sf_dir):
    """Every document as a unit vector of its words' hashes, marked as a passage; a stand-in for a hosted model that needs none."""
    t = C.embedded(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "passage:")
    top, seventh = F.array_max(F.map_values("dims")) / F.col("norm"), F.coalesce(F.element_at("dims", F.lit(7)), F.lit(0)) / F.col("norm")
    return t.select("doc_id", F.size("dims").cast("long").alias("dims"), F.round(top, 6).alias("top"), F.round(seventh, 6).alias("seventh"))


@query("""with e as (select event_id, user_id, ts, event_type, case event_type when 'error' then 'paused' when 'signup' then 'capturing' end as state from events),
s as (select *, coalesce(last_value(state ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), 'capturing') as now from e)
select event_id, now = 'capturing' as kept, case when now <> 'capturing' then '' when event_type = 'purchase' then 'archive,channel,records,store' else 'channel,records' end as sinks from s where event_type not in ('error', 'signup')""")
def segments_handled(spark, sf_dir):
    """Segments as they come in: those heard while capture was paused are dropped, the others go to their sinks."""
    e = table(spark, sf_dir, "events")
    moves = e.where("event_type in ('error', 'signup')").select("user_id", F.col("ts").alias("at"), "event_id", F.expr("if(event_type = 'error', 'paused', 'capturing')").alias("state"))
    heard = e.where("event_type not in ('error', 'signup')").select("user_id", F.col("ts").alias("at"), "event_id", (F.col("event_type") == "purchase").alias("speech"))
    return C.handled(heard, moves, "user_id")
