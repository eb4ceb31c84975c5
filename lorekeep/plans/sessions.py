"""Levels, curves, speakers and answers of listening sessions, and what streams of them give."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import sessions as X
from ..operators import store
from ..operators import timeline as T
from ..operators import vectors as V
from ..operators.governance import first_match
from ..sources.views import OBSERVATIONS, WORDS, epoch, observations, table, words
from ..streaming import gate, live
from .catalog import query
from .timeline import _RUNS, _runs


@query(f"""with {WORDS}, m as (select id, speaker, case when count(*) over w >= 8 then quantile_cont(loud, 0.5) over w end as level from words where not suspect window w as (partition by speaker order by "end", id rows between 39 preceding and current row))
select id, speaker, round(level, 6) as level from m""")
def recent_medians(spark, sf_dir):
    return X.recent_medians(words(spark, sf_dir), "speaker").select("id", "speaker", F.round("level", 6).alias("level"))


@query(f"with {WORDS} select bool_or(pitch is not null) as pitch, bool_or(loud is not null) as loud, bool_or(nullif(dur, dur) is not null) as dur from words")
def live_cues(spark, sf_dir):
    return X.live_cues(words(spark, sf_dir).withColumn("dur", F.expr("nullif(dur, dur)")), ["pitch", "loud", "dur"])


_PLACED = f"""{WORDS}, p as (select *, row_number() over w - 1 as k, count(*) over (partition by speaker, sentence) as n from words window w as (partition by speaker, sentence order by "end", id)),
q as (select *, case when n > 1 then k / (n - 1.0) else 0.0 end as place, -10.0 - speaker % 5 as slope from p)"""


def _placed(spark, sf_dir):
    rows = words(spark, sf_dir).selectExpr("*", "row_number() over (partition by speaker, sentence order by end, id) - 1 as k", "count(*) over (partition by speaker, sentence) as n")
    return rows.selectExpr("*", "if(n > 1, cast(k as double) / (n - 1), 0.0D) as place", "-10.0D - speaker % 5 as slope")


@query(f"with {_PLACED} select id, round(pitch - (200 + slope * place), 4) as stored, round(pitch - (avg(pitch) over s + slope * (place - avg(case when pitch is not null then place end) over s)), 4) as levelled from q window s as (partition by speaker, sentence)")
def declines_removed(spark, sf_dir):
    """Pitch above a stored curve, and above the speaker's stored slope through its sentence's own middle."""
    rows = X.level_decline(_placed(spark, sf_dir), "pitch", ["speaker", "sentence"])
    stored = X.stored_decline(F.col("pitch"), F.col("place"), F.col("slope"), F.lit(200.0))
    return rows.select("id", F.round(stored, 4).alias("stored"), F.round("rest", 4).alias("levelled"))


@query(f"""with e as (select user_id as session, ts, event_id, case when user_id % 17 = 3 then -90 else 20 * log10(value / 400 + 0.001) end as level, case when user_id % 19 = 4 then 0 else value end as value from events),
l as (select *, coalesce(value >= 80, false) as loud, coalesce(lag(value >= 80) over w, false) as p1, coalesce(lag(value >= 80, 2) over w, false) as p2, row_number() over w as k from e window w as (partition by session order by ts, event_id)),
o as (select *, sum((loud and p1)::int) over (partition by session order by ts, event_id) as opened from l),
c as (select session, count(*) as frames, max(level) as level_max, count(*) filter (loud) as speech, max(opened) as opens, count(*) filter (opened > 0 and not loud and not p1 and not p2 and k > 2) as closes, count(*) filter (value > 230) as with_words from o group by session)
select session, case when frames = 0 then 'frames' when level_max < -70 then 'silence' when speech = 0 then 'speech' when opens = 0 then 'in a row' when closes = 0 then 'closed' when with_words = 0 then 'words' end as first_silent from c""")
def stages_seen(spark, sf_dir):
    """What each user's session saw: some devices deliver silence, some voices aren't heard, some are heard but never twice in a row, or never fall silent for three frames, or say nothing."""
    w = "over (partition by session order by ts, event_id)"
    e = table(spark, sf_dir, "events").selectExpr("user_id as session", "ts", "event_id", "if(user_id % 17 = 3, -90D, 20 * log10(value / 400 + 0.001)) as level", "if(user_id % 19 = 4, 0D, value) as value")
    frames = e.selectExpr("*", "value >= 80 as loud", f"coalesce(lag(value >= 80) {w}, false) as p1", f"coalesce(lag(value >= 80, 2) {w}, false) as p2", f"row_number() {w} as k").selectExpr("*", f"sum(int(loud and p1)) {w} as opened")
    n = lambda c: F.count_if(F.expr(c))
    c = frames.groupBy("session").agg(F.count("*").alias("frames"), F.max("level").alias("level_max"), n("loud").alias("speech"), F.max("opened").alias("opens"), n("opened > 0 and not loud and not p1 and not p2 and k > 2").alias("closes"), n("value > 230").alias("with_words"))
    return X.diagnosed(c)


@query(f"""with {WORDS}, s as (select speaker, sentence as segment, min("end") as start, max("end") + 1 as stop from words group by 1, 2)
select s.speaker, s.segment, w.id, w."end" >= s.start as "new" from s join words w on w.speaker = s.speaker and w."end" >= s.start - 43200 and w."end" < s.stop""")
def scored_with_context(spark, sf_dir):
    """What the scoring of each day's words looks at: those of the half day before it and its own."""
    w = words(spark, sf_dir)
    starts = w.groupBy("speaker", F.col("sentence").alias("segment")).agg(F.min("end").alias("start"), (F.max("end") + 1).alias("stop"))
    return X.with_context(w.select("speaker", "id", "end"), "speaker", starts, 43200.0)


@query(f"""with {WORDS}, m as (select speaker, count(*) as n, quantile_cont(loud, 0.5) as median from words group by speaker)
select id, case when n >= 50 then 'own' when n >= 10 then 'room' else 'none' end as held_against, round(-0.5 * (value - median), 6) as off from words join m using (speaker)""")
def distance_offsets(spark, sf_dir):
    w = words(spark, sf_dir)
    m = w.groupBy("speaker").agg(F.count("*").alias("n"), F.percentile("loud", F.lit(0.5)).alias("median"))
    return w.join(m, "speaker").select("id", X.level_reference(F.col("n")).alias("held_against"), F.round(X.offset(F.lit(-0.5), F.col("value"), F.col("median")), 6).alias("off"))


@query(f"with {WORDS} select speaker, round(quantile_cont(loud, 0.9) - quantile_cont(loud, 0.1), 6) as range, count(loud) as n from words group by speaker")
def dynamic_ranges(spark, sf_dir):
    return X.dynamic_range(words(spark, sf_dir), "speaker", "loud")


@query(f"""with {_RUNS}, w as (select id, speaker, "end" - 7200 as a, "end" as b from words), l as (select w.id, sum(least(b, t1) - greatest(a, t0)) as lost from w join runs r on r.speaker = w.speaker and b > t0 and a < t1 group by w.id)
select w.id, round(b - a - coalesce(lost, 0), 3) as seconds from w left join l using (id)""")
def speech_seconds(spark, sf_dir):
    """Of the two hours before each word those that aren't in a silence."""
    w = words(spark, sf_dir).selectExpr("id", "speaker", "end - 7200 as a", "end as b")
    runs = _runs(spark, sf_dir).selectExpr("speaker", "t0 as c", "t1 as d")
    return X.speech_seconds(w, runs, ["speaker"], 14400.0).select("id", F.round("seconds", 3).alias("seconds"))


@query("select user_id, event_id as id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 20")
def own_speech_kept(spark, sf_dir):
    """The twenty newest windows of each user's own speech, as many as are remembered here."""
    return X.kept_windows(table(spark, sf_dir, "events").selectExpr("user_id", "event_id as id", "ts as at"), "user_id", 20).select("user_id", "id")


@query("""with w as (select vec_id // 100 as file, vec_id % 100 as c, vec_id % 100 + 1.5 as d, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), u as (select f.file * 1000 + k as id, f.file, k * 5 + 0.2 as a, k * 5 + 3.2 as b from (select distinct file from w) f, (select unnest(generate_series(0, 19)) as k)),
m as (select u.id, v, unnest(generate_series(1, 64)) as pos from u join w on u.file = w.file and u.b > w.c and u.a < w.d), avgd as (select id, pos, avg(v[pos]) as x from m group by id, pos),
e as (select id, list(x order by pos) as x from avgd group by id), p as (select label, pos, avg(v[pos]) as x from (select label, list_transform(embedding, lambda x: cast(x as double)) as v, unnest(generate_series(1, 64)) as pos from embeddings) group by label, pos),
n as (select label, sqrt(sum(x * x)) as n from p group by label), c as (select label, list(round(x / n, 6) order by pos) as c from p join n using (label) group by label),
d as (select e.id, label, round(1 - list_dot_product(x, c), 6) as d from e, c) select id, min(d) as distance from d group by id""")
def utterance_speakers(spark, sf_dir):
    """Utterances of three seconds by the windows that overlap them: the distance of their mean to the nearest person."""
    v = table(spark, sf_dir, "embeddings")
    windows = v.selectExpr("vec_id div 100 as file", "cast(vec_id % 100 as double) as c", "vec_id % 100 + 1.5D as d", "embedding as vector")
    files = windows.select("file").distinct().select("file", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    said = files.selectExpr("file * 1000 + k as id", "file", "k * 5 + 0.2D as a", "k * 5 + 3.2D as b")
    mean = X.utterance_vectors(said, windows, ["file"], 5.0)
    prints = V.centroids(v).select(F.col("label").alias("person"), F.col("centroid").alias("embedding"))
    return V.match_people(mean, prints).select(F.col("vec_id").alias("id"), "distance")


@query(f"""with {OBSERVATIONS}, c as (select c_custkey as caller, c_mktsegment <> 'BUILDING' as can_read, c_acctbal > 0 as outward from customer where c_custkey % 50 = 0),
v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings), o as (select *, session * 8 + turn as vec_id from obs),
s as (select q.vec_id as caller, v.vec_id, round(list_dot_product(v.e, q.e), 6) as sim from v, (select * from v where vec_id % 50 = 0) q),
r as (select *, row_number() over (partition by caller order by sim desc, vec_id) as place from s qualify place <= 10)
select c.caller, case when not can_read then 'may not read' when not outward then 'held back' else 'released' end as decision, case when can_read and outward then place end as place, case when can_read and outward then o.id end as id, case when can_read and outward then person || ': ' || text end as line
from c left join r on r.caller = c.caller and can_read and outward left join o on o.vec_id = r.vec_id""")
def memory_searched(spark, sf_dir):
    """Every fiftieth caller asks, with the vector of its number: those who may read and to whom things may go get the ten nearest observations as lines, the others the reason. Held against all rows."""
    obs, v = observations(spark, sf_dir), table(spark, sf_dir, "embeddings")
    callers = table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").selectExpr("c_custkey as caller", "c_mktsegment != 'BUILDING' as can_read", "c_acctbal > 0 as outward")
    decided = callers.withColumn("decision", first_match((~F.col("can_read"), "may not read"), (~F.col("outward"), "held back"), default="released"))
    released = decided.where("decision = 'released'")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("caller"), "embedding").join(released.select("caller"), "caller", "left_semi")
    hits = V.top_k_each(v, asked, 10)
    lines = obs.select("id", F.expr("session * 8 + turn as vec_id"), F.concat("person", F.lit(": "), "text").alias("line"))
    shown = hits.join(lines, "vec_id", "left").select("caller", "place", "id", "line")
    out = released.join(shown, "caller", "left").select("caller", "decision", "place", "id", "line")
    return out.unionByName(decided.where("decision != 'released'").select("caller", "decision"), allowMissingColumns=True)


_UTTERED = "u as (select user_id as session, epoch(ts) / 600 as t, event_type = 'signup' as named, event_type in ('click', 'view') as request, row_number() over (partition by user_id order by ts, event_id) as k from events)"


@query(f"""with recursive {_UTTERED}, f as (select session, k, t, named as addressed, case when named then t + 45 else 0.0 end as until from u where k = 1
  union all select u.session, u.k, u.t, u.named or (u.t < f.until and u.request), case when u.named or (u.t < f.until and u.request) then u.t + 45 else f.until end from f join u on u.session = f.session and u.k = f.k + 1)
select session, round(t, 6) as "at", addressed from f""")
def attention_held(spark, sf_dir):
    """Events as utterances, ten minutes taken as a second: the name opens attention, what is addressed in it holds it. A stream over files, each batch's state kept by session."""
    rows = table(spark, sf_dir, "events").selectExpr("cast(user_id as string) as session", f"{epoch('ts')} / 600 as at", "event_type = 'signup' as named", "event_type in ('click', 'view') as request")
    out = streamed(spark, rows, gate.attended_stream)
    return out.select(F.col("session").cast("long").alias("session"), F.round("at", 6).alias("at"), "addressed")


def streamed(spark, rows, operator, mode: str = "append"):
    """What an operator makes of rows as a stream: written to files of the shared folder, read as a stream to its end, its output a table there."""
    base = f"{store.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{base}/in")
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = operator(spark.readStream.schema(rows.schema).parquet(f"{base}/in")).writeStream.outputMode(mode).format("parquet")
        q.option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()
    finally:
        if held is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    return spark.read.parquet(f"{base}/out")


@query("select date_trunc('hour', ts) as start, event_type as key, count(*) as n, round(avg(value), 6) as level from events group by 1, 2")
def level_windows_stream(spark, sf_dir):
    """The hours of a stream of events that comes in three parts, late by an hour at most, and ends with one of a far later time, by which all hours before it become final."""
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"), "value").withColumn("at", F.unix_millis("ts"))
    end = rows.agg((F.max("ts") + F.expr("interval 400 days")).alias("ts")).where("ts is not null").selectExpr("ts", "'end' as key", "0.0D as value", "unix_millis(ts) as at")
    base = live.fed([*live.slices(rows, "at", 3), end], lambda stream, base: gate.level_windows(stream, "1 hour").writeStream.format("parquet").option("path", f"{base}/out"))
    return spark.read.parquet(f"{base}/out").where("key != 'end'").select(F.col("start").cast("timestamp_ntz").alias("start"), "key", "n", F.round("level", 6).alias("level"))


@query("""with o as (select user_id as session, event_id as id, ts as a, ts + interval 20 minutes as b from events where event_type <> 'error'), s as (select user_id as session, ts as c, ts + interval 10 minutes as d from events where event_type = 'error')
select o.session, id, count(*) as heard from o join s on o.session = s.session and b > c - interval 300 milliseconds and a < d + interval 600 milliseconds and c between a - interval 1 hour and a + interval 1 hour group by 1, 2""")
def self_heard_stream(spark, sf_dir):
    """Utterances of twenty minutes that overlap own speech, found by joining both as streams."""
    e = table(spark, sf_dir, "events").selectExpr("user_id as session", "event_id as id", "event_type", "cast(ts as timestamp) as a").withColumn("at", F.unix_millis("a"))

    def start(stream, base):
        said = stream.where("event_type != 'error'").selectExpr("session", "id", "a", "a + interval 20 minutes as b")
        own = stream.where("event_type = 'error'").selectExpr("session", "a as c", "a + interval 10 minutes as d")
        return gate.self_heard_stream(said, own, delay="1 hour").writeStream.format("parquet").option("path", f"{base}/out")

    return spark.read.parquet(f"{live.fed(live.slices(e, 'at', 3), start, settings=live.JOINED)}/out").groupBy("session", "id").agg(F.count("*").alias("heard"))
