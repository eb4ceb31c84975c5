"""Narrowing, releasing, archiving, identifiers, marks as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import archive as A
from ..operators import prosody as P
from ..operators import relevance as R
from ..operators import timeline as T
from ..sources.views import OBSERVATIONS, WORDS, epoch, observations, table, words
from .catalog import query
from .timeline import _window_sql


@query(f"""with {OBSERVATIONS}, n as (select id, session, case when started_at - lag(ended_at) over o <= 3 then lag(id) over o end as prev, case when lead(started_at) over o - ended_at <= 3 then lead(id) over o end as next from obs window o as (partition by session order by started_at, id)),
h as (select *, session * 10 + turn as rank from obs where (session + turn) % 3 <> 0), r as (select rank, 0 as role, id from h
  union all select h.rank, 1, prev from h join n using (id) where turn % 2 = 0 and prev is not null union all select h.rank, 1, next from h join n using (id) where turn % 2 = 0 and next is not null)
select id, min(rank) as rank, case when min_by(role, (rank, role)) = 0 then 'hit' else 'neighbour' end as role from r group by id""")
def narrow_hits(spark, sf_dir):
    obs = observations(spark, sf_dir)
    hits = obs.selectExpr("id", "session * 10 + turn as rank", "if((session + turn) % 3 = 1 and turn > 100, null, (session + turn) % 3 != 0) as keep", "turn % 2 = 0 as needs_context")
    return R.narrowed(hits, obs)


@query(_window_sql(OBSERVATIONS, 400, 5, """, t as (select o.id, o.text, w.text as win, len(regexp_extract_all(o.text, '\\S+')) as n, len(regexp_extract_all(w.text, '\\S+')) as m from obs o join windows w using (id))
select id, case when n < 40 and m > n then win else text end as text, n < 40 and m > n as released from t"""))
def expand_short(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return R.released(obs.select("id", "text"), T.centred_windows(obs, 400, 5), 40)


_PCM = "list_transform(embedding, lambda x: cast(trunc(greatest(least(cast(x as double), 1.0), -1.0) * 32767) as integer))"


@query(f"with d as (select vec_id, sha256(array_to_string({_PCM}, ',')) as digest from embeddings) select vec_id, digest, substr(digest, 1, 2) || '/' || digest as path from d")
def archive_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", A.digest(A.pcm16(F.col("embedding"))).alias("digest"))
    return rows.withColumn("path", A.path(F.col("digest")))


@query("select digest from (select distinct sha256(text) as digest from documents) where digest not in (select sha256(text) from documents where doc_id % 4 = 0)")
def archive_put_new(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return A.new_blobs(rows, rows.where("doc_id % 4 = 0")).select("digest")


_SAMPLES = "s as (select user_id as track, row_number() over (partition by user_id order by ts, event_id) - 1 as n, value from events)"


def _samples(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("user_id as track", "row_number() over (partition by user_id order by ts, event_id) - 1 as n", "value")


@query(f"with {_SAMPLES} select track, n // 16 as block, round(10 * log10(avg(value * value)), 6) as db, count(value) as n from s group by track, n // 16")
def block_levels(spark, sf_dir):
    return A.block_levels(_samples(spark, sf_dir), "track", 16)


@query(f"with {_SAMPLES} select track, n, round(10 * log10(avg(value * value) over (partition by track order by n rows between 2 preceding and 2 following)), 6) as db from s")
def energy_envelope(spark, sf_dir):
    return A.envelope(_samples(spark, sf_dir), "track", 2)


@query("""with e as (select event_id, user_id, cast(round(epoch(ts) * 1000) as bigint) // 600000 as ms from events), m as (select *, max(ms) over (partition by user_id order by event_id rows unbounded preceding) as clock_ms from e)
select event_id, clock_ms, row_number() over (partition by user_id, clock_ms order by event_id) - 1 as clock_n from m""")
def hybrid_clock(spark, sf_dir):
    """Ticks of ten minutes in the order of arrival, which is that of ids and not of time."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", f"cast(round({epoch('ts')} * 1000) as bigint) div 600000 as ms")
    return ids.hybrid_clock(rows, "user_id", "ms", ["event_id"]).select("event_id", "clock_ms", F.col("clock_n").cast("long").alias("clock_n"))


@query("select p_partkey as id, sha256('brand=' || p_brand || chr(10) || 'size=' || cast(p_size as varchar) || chr(10) || 'type=' || p_type) as digest from part")
def settings_digest(spark, sf_dir):
    settings = F.create_map(F.lit("type"), "p_type", F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), "p_brand")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ids.settings_digest(settings).alias("digest"))


def _spoken(events):
    said = F.concat(F.lower(F.date_format("ts", "h:mm a")), F.lit(" on "), F.date_format("ts", "d MMMM, yyyy"))
    return events.select("event_id", ids.spoken_time(said).alias("at"))


@query("select event_id, date_trunc('minute', ts) as at from events")
def spoken_times(spark, sf_dir):
    """Timestamps written as people say them and read back."""
    return _spoken(table(spark, sf_dir, "events"))


@query(f"""with {WORDS}, r as (select speaker, avg(value) as m, stddev_samp(value) as s from words where not suspect group by speaker), z as (select w.*, (value - m) / nullif(s, 0) as z from words w join r using (speaker)),
k as (select *, case when round(z, 6) > 1.659 then '**' || kind || '**' when round(z, 6) > 1.143 then '*' || kind || '*' else kind end as t from z)
select speaker, sentence, string_agg(t, ' ' order by "end", id) as text, count(*) as n from k group by speaker, sentence having count(*) >= 2""")
def rendered_marks(spark, sf_dir):
    """Sentences with their strong words marked; none of a single word."""
    w = words(spark, sf_dir)
    good = F.when(~F.col("suspect"), F.col("value"))
    by = "partition by speaker"
    z = w.withColumn("g", good).selectExpr("*", f"(value - avg(g) over ({by})) / nullif(stddev_samp(g) over ({by}), 0) as z")
    level = P.mark_level(F.round("z", 6))
    marked = z.withColumn("t", F.when(level == 2, F.concat(F.lit("**"), "kind", F.lit("**"))).when(level == 1, F.concat(F.lit("*"), "kind", F.lit("*"))).otherwise(F.col("kind")))
    lines = marked.groupBy("speaker", "sentence").agg(F.array_sort(F.collect_list(F.struct("end", "id", "t"))).alias("r"), F.count("*").alias("n")).where("n >= 2")
    return lines.select("speaker", "sentence", F.array_join(F.transform("r", lambda x: x["t"]), " ").alias("text"), "n")


@query(f"""with {OBSERVATIONS}, p as (select *, lag(person) over (partition by session order by started_at, id) as before from obs)
select id, case when before is distinct from person then upper(substr(person, 1, 1)) || substr(person, 2) || ': ' else '' end || text as line from p""")
def speaker_prefixes(spark, sf_dir):
    before = F.expr("lag(person) over (partition by session order by started_at, id)")
    rows = observations(spark, sf_dir).withColumn("before", before)
    return rows.select("id", F.concat(F.when(~F.col("before").eqNullSafe(F.col("person")), F.concat(F.initcap("person"), F.lit(": "))).otherwise(""), "text").alias("line"))
