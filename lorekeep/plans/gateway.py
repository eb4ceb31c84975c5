"""What callers ask of the store through the gate: writes, look-ups, state, replies, recordings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import beliefs as B
from ..operators import governance as G
from ..operators import recordings as R
from ..operators import sessions as X
from ..operators import store as S
from ..sources.views import BELIEFS, NEWEST, WORDS, beliefs, newest, replaces, table, words
from .access import _callers
from .catalog import query
from .store import _PROPOSALS, _proposals

_CUSTOMER = "c as (select c_custkey as caller, c_acctbal > 5000 as can_write from customer)"


@query(f"""with {_PROPOSALS}, {_CUSTOMER} select p.id, case when c.caller is null then 'unknown' when not can_write then 'may not write' else reason end as outcome from p join beliefs b on b.id = p.id left join c on c.caller = b.owner * 2""")
def beliefs_offered(spark, sf_dir):
    """Beliefs that callers offer: whether they may write, then whether the belief can stand."""
    rows = S.proposed(_proposals(spark, sf_dir))
    asked = G.admitted(rows.select("id", (F.col("owner") * 2).alias("caller"), F.lit("write_belief").alias("tool")), _callers(spark, sf_dir))
    return rows.join(asked.select("id", "decision"), "id").select("id", F.when(F.col("decision") != "ok", F.col("decision")).otherwise(F.col("reason")).alias("outcome"))


@query(f"""with {BELIEFS}, cur as (select id, last_value(id) over (partition by owner order by formed_at, id rows between unbounded preceding and unbounded following) as current from beliefs), w as (select *, weight * pow(0.5, greatest({NEWEST} - formed_at, 0) / 86400 / 30.0) as x from beliefs)
select cur.id as asked, w.id, w.about, round(w.certainty, 3) as certainty, round(x, 3) as weight, cur.id <> w.id as followed from cur join w on w.id = cur.current where cur.id % 50 = 0""")
def beliefs_fetched(spark, sf_dir):
    """Every fiftieth belief asked for by id and followed to what is current in its place; looked up in all beliefs."""
    b = beliefs(spark, sf_dir)
    at = B.current_versions(b, replaces(b)).where("id % 50 = 0").select(F.col("id").alias("asked"), F.col("current").alias("id"))
    weight = B.decayed(F.col("weight"), F.col("formed_at"), F.lit(newest(b)))
    return at.join(b, "id").select("asked", "id", "about", F.round("certainty", 3).alias("certainty"), F.round(weight, 3).alias("weight"), (F.col("asked") != F.col("id")).alias("followed"))


@query("""select 'events' as what, cast(count(*) as varchar) as value from events union all select 'documents', cast(count(*) as varchar) from documents union all select 'turns', cast(count(*) as varchar) from conversations
union all select 'transition ' || row_number() over (order by ts desc, event_id desc), event_type || ' of ' || user_id from (select * from events order by ts desc, event_id desc limit 8)""")
def state_summary(spark, sf_dir):
    """The state at a glance: how much there is, and the last eight transitions."""
    count = lambda t, what: table(spark, sf_dir, t).agg(F.count("*").cast("string").alias("value")).select(F.lit(what).alias("what"), "value")
    last = table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(8)
    place = F.expr("row_number() over (order by ts desc, event_id desc)")
    shown = last.select(F.concat(F.lit("transition "), place.cast("string")).alias("what"), F.concat("event_type", F.lit(" of "), F.col("user_id").cast("string")).alias("value"))
    return count("events", "events").union(count("documents", "documents")).union(count("conversations", "turns")).union(shown)


@query("""with r as (select event_id, case event_id % 4 when 0 then '{"keep": [1, ' || (event_id % 9) || '], "why": "near"}' when 1 then '{"keep": [' when 2 then '{"why": "none"}' else '{"keep": []}' end as reply from events)
select event_id, case event_id % 4 when 1 then 'malformed' when 2 then 'no answer' else 'ok' end as state, case event_id % 4 when 0 then '1,' || (event_id % 9) when 3 then '' end as keep from r""")
def replies_read(spark, sf_dir):
    """A judge's replies read by their schema: what can't be read, what lacks the answer, and the answers."""
    k = F.col("event_id") % 4
    reply = F.when(k == 0, F.concat(F.lit('{"keep": [1, '), (F.col("event_id") % 9).cast("string"), F.lit('], "why": "near"}'))).when(k == 1, F.lit('{"keep": [')).when(k == 2, F.lit('{"why": "none"}')).otherwise(F.lit('{"keep": []}'))
    return G.replies(table(spark, sf_dir, "events").select("event_id", reply.alias("reply"))).select("event_id", "state", F.array_join(F.col("keep").cast("array<string>"), ",").alias("keep"))


@query("select 'v' || vec_id as path, len(embedding) as n, cast(list_sum(list_transform(embedding, lambda x: trunc(greatest(least(cast(x as double), 1.0), -1.0) * 32767))) as bigint) as total from embeddings")
def recordings_loaded(spark, sf_dir):
    """Vectors as recordings of two channels, written as WAV and loaded as one channel again."""
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("path"), F.col("embedding").cast("array<double>").alias("samples"))
    files = R.save(rows, f"{S.shared_folder(spark)}/recordings-{uuid.uuid4().hex}", channels=2)
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda s, x: s + F.round(x * 32767).cast("long"))
    return R.load(files).select("path", F.size("samples").cast("long").alias("n"), total.alias("total"))


@query(f"""with {WORDS}, z as (select id, (pitch - avg(pitch) over s) / nullif(stddev_samp(pitch) over s, 0) as pitch, (loud - avg(loud) over s) / nullif(stddev_samp(loud) over s, 0) as loud, (dur - avg(dur) over d) / nullif(stddev_samp(dur) over d, 0) as dur from words window s as (partition by speaker), d as (partition by speaker, sentence))
select id, round(pitch, 5) as pitch, round(loud, 5) as loud, round(dur, 5) as dur from z""")
def default_cues(spark, sf_dir):
    """The scores that count by default: pitch and level against all of a speaker's words, duration against those of the day."""
    z = lambda c, by: f"({c} - avg({c}) over (partition by {by})) / nullif(stddev_samp({c}) over (partition by {by}), 0)"
    rows = words(spark, sf_dir).selectExpr("id", f"{z('pitch', 'speaker')} as pitch_lt", f"{z('loud', 'speaker')} as loud_lt", f"{z('dur', 'speaker, sentence')} as dur_st")
    return X.default_cues(rows).select("id", *[F.round(c, 5).alias(c) for c in ("pitch", "loud", "dur")])

