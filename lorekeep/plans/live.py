"""Streams of a session's life: segments into sinks, requests that wait, devices that stall, people that are learned."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.views import epoch, table
from ..streaming import live as L
from .catalog import query

_HOUR_MS = 3_600_000

_SEGMENTS = """e as (select user_id as session, epoch(ts) as "at", event_id as id, value >= 80 as loud, case event_type when 'error' then 'paused' when 'signup' then 'capturing' end as move from events),
m as (select *, coalesce(last_value(move ignore nulls) over (partition by session order by "at", id rows between unbounded preceding and current row), 'capturing') = 'capturing' as capturing from e),
f as (select *, row_number() over (partition by session order by "at", id) as f from m where move is null),
g as (select session, f, loud and false as open, loud::int as louds, 0 as quiet, 0::bigint as start_f, 0::bigint as closed_f, false as closes from f where f = 1 union all
  select session, f, case when open then not (not loud and quiet >= 9) else loud and louds >= 1 end, case when open then (case when not loud and quiet >= 9 then 0 else louds end) when loud then louds + 1 else 0 end,
    case when open and not loud then quiet + 1 else 0 end, case when not open and loud and louds >= 1 then greatest(f - 6, closed_f + 1) else start_f end, case when open and not loud and quiet >= 9 then f else closed_f end, open and not loud and quiet >= 9
  from (select f.session, f.f, f.loud, g.open, g.louds, g.quiet, g.start_f, g.closed_f from g join f on f.session = g.session and f.f = g.f + 1)),
seg as (select g.session, row_number() over (partition by g.session order by g.f) as segment, g.start_f, g.f as end_f, f.capturing from g join f on f.session = g.session and f.f = g.f where closes),
fr as (select s.session, s.segment, s.capturing, f.f, f.id, f."at", f.loud from seg s join f on f.session = s.session and f.f between s.start_f and s.end_f),
tot as (select session, segment, capturing, min("at") as t0, max("at") as t1, count(*) as n, sha256(string_agg(id::varchar, ',' order by f)) as digest from fr group by all),
l as (select *, coalesce(f - lag(f) over w > 3, true)::int as fresh from fr where loud and capturing window w as (partition by session, segment order by f)),
u as (select *, sum(fresh) over (partition by session, segment order by f) as part from l)"""


@query(f"""with recursive {_SEGMENTS} select 'archive' as sink, session, segment, 0 as part, null as t0, null as t1, n, digest as key from tot where capturing
union all select 'records', session, segment, 0, t0, t1, n, null from tot where capturing union all select 'channel', session, segment, 0, t0, t1, null, capturing::varchar from tot
union all select 'store', session, segment, part, min("at"), max("at"), count(*), null from u group by session, segment, part""")
def session_sinks(spark, sf_dir):
    """Events as frames and moves of their users' sessions, streamed in three parts through the session processor into four sinks, each read back."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "cast(user_id as string) as session", f"{epoch('ts')} as at", "event_id as id", "least(1.0D, value / 160) as p", "case event_type when 'error' then 'paused' when 'signup' then 'capturing' end as move"
    )
    base = L.fed(L.slices(rows, "at", 3), L.listening())
    read = lambda name, *cols: L.sink(spark, base, name).selectExpr(f"'{name}' as sink", "cast(session as long) as session", "segment", *cols)
    none = "cast(null as double)"
    parts = [
        read("archive", "0L as part", f"{none} as t0", f"{none} as t1", "n", "digest as key"),
        read("records", "0L as part", "t0", "t1", "frames as n", "cast(null as string) as key"),
        read("channel", "0L as part", "t0", "t1", "cast(null as long) as n", "cast(capturing as string) as key"),
        read("store", "utterance as part", "start as t0", "stop as t1", "frames as n", "cast(null as string) as key"),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def _hourly(spark, sf_dir, key):
    """Events at the start of their hours, so that deadlines are met exactly, and a last row far later, by which all time has passed."""
    rows = table(spark, sf_dir, "events").selectExpr(f"cast(user_id as string) as {key}", "cast(date_trunc('hour', ts) as timestamp) as at", "event_id as id", "event_type as kind")
    rows = rows.withColumn("ms", F.unix_millis("at"))
    end = rows.agg((F.max("at") + F.expr("interval 400 days")).alias("at")).selectExpr(f"'end' as {key}", "at", "-1L as id", "'end' as kind").withColumn("ms", F.unix_millis("at"))
    return [*L.slices(rows, "ms", 3), end.where("at is not null")]


@query("""with e as (select user_id as caller, event_id as id, event_type, epoch_ms(date_trunc('hour', ts)) as ms from events), d as (select *, case event_type when 'click' then 'approved' when 'view' then 'denied' end as said from e),
n as (select *, first_value(case when said is not null then ms end ignore nulls) over w as at_ms, first_value(said ignore nulls) over w as next from d window w as (partition by caller order by ms, id rows between 1 following and unbounded following))
select caller, id, ms as asked, case when at_ms - ms < 32400000 then next else 'timeout' end as outcome, case when at_ms - ms < 32400000 then at_ms else ms + 32400000 end as resolved from n where event_type = 'purchase'""")
def requests_waited(spark, sf_dir):
    """Purchases as requests that wait nine hours for the next click (approves) or view (denies) of their user."""
    parts = [p.withColumn("kind", F.expr("case kind when 'purchase' then 'ask' when 'click' then 'approve' when 'view' then 'deny' else kind end")) for p in _hourly(spark, sf_dir, "caller")]
    base = L.fed(parts, L.timed(L.Waiting(9 * _HOUR_MS), "caller"))
    return spark.read.parquet(f"{base}/out").withColumn("caller", F.col("caller").cast("long"))


@query("""with e as (select user_id as device, epoch_ms(date_trunc('hour', ts)) as ms from events), n as (select device, ms, row_number() over w as blocks, lead(ms) over w as next from e window w as (partition by device order by ms))
select device, ms as last, blocks from n where next is null or next - ms > 21600000""")
def devices_stalled(spark, sf_dir):
    """Users as devices that stall when nothing comes from them for more than six hours."""
    base = L.fed([p.select("device", "at", "ms") for p in _hourly(spark, sf_dir, "device")], L.timed(L.Stalled(6 * _HOUR_MS), "device"))
    return spark.read.parquet(f"{base}/out").where("device != 'end'").withColumn("device", F.col("device").cast("long"))


@query(None)
def people_learned(spark, sf_dir):
    """The learned prints of everybody after all vectors: a person's first vector is the anchor, the next person's anchor the runner-up. What is heard is the anchor with a half, one, two or four times a vector added, so near, borderline and strange rows come."""
    v = table(spark, sf_dir, "embeddings").selectExpr("cast(label as long) as person", "vec_id as id", "embedding")
    anchors = v.groupBy("person").agg(F.min_by("embedding", "id").alias("anchor"))
    rivals = anchors.selectExpr("person", "anchor", "coalesce(lead(anchor) over (order by person), first(anchor) over (order by person)) as rival")  # one row a person
    dot = F.aggregate(F.zip_with("embedding", "rival", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    heard = F.zip_with("anchor", "embedding", lambda x, y: x.cast("double") + F.element_at(F.array(*map(F.lit, (0.5, 1.0, 2.0, 4.0))), (F.col("id") % 4 + 1).cast("int")) * y)
    rows = v.join(rivals, "person").withColumn("embedding", heard).select("person", F.col("id").cast("double").alias("at"), "id", "embedding", "anchor", (1 - dot / (norm("embedding") * norm("rival"))).alias("others"))
    base = L.fed(L.slices(rows, "at", 3), L.learning)
    out = spark.read.parquet(f"{base}/out")
    last = out.groupBy("person").agg(F.max("seen").alias("seen"))
    return out.join(last, ["person", "seen"]).where("place is not null").select("person", "place", "seen", "confident", "borderline", "consolidations", F.round("strength", 6).alias("strength"), "matches", F.round(F.col("vector")[0], 6).alias("head"))


@query(f"""with e as (select user_id as device, epoch(ts) as "at", event_id as id, case when event_type = 'view' then null else cast(floor(value * 997) as bigint) + 1 end as samples from events),
k as (select *, sum(samples) over w as cum, count(samples) over w as n, count(*) filter (samples is null) over w as part from e window w as (partition by device order by "at", id rows between unbounded preceding and current row)),
b as (select *, "at" - first_value("at") over w as y, (cum - first_value(cum) over w) / 16000.0 as x from k where samples is not null window w as (partition by device order by "at", id)),
q as (select device, part, max(cum) // 512 as ends from k where cum is not null group by device, part),
d as (select device, sum(greatest(0, ends - begins - {L.QUEUE_MAX})) as dropped from (select *, coalesce(lag(ends) over (partition by device order by part), 0) as begins from q) group by device)
select device, count(*) as blocks, cast(max(cum) as bigint) as samples, cast(max(cum) // 512 as bigint) as frames, cast(max(cum) % 512 as bigint) as carry, cast(any_value(dropped) as bigint) as dropped,
  round(arg_max(y - x, n), 4) as drift, round(arg_max(y - x, (abs(y - x), -n)), 4) as drift_max, round(case when max(x) > min(x) then regr_slope(y, x) end, 4) as rate from b join d using (device) group by device""")
def clocks_followed(spark, sf_dir):
    """Events as blocks of their users' devices, views as reads that empty the queue: what each device's clock and queue came to, in three parts."""
    rows = table(spark, sf_dir, "events").selectExpr("cast(user_id as string) as device", f"{epoch('ts')} as at", "event_id as id", "if(event_type = 'view', null, cast(floor(value * 997) as bigint) + 1) as samples")
    out = spark.read.parquet(f"{L.fed(L.slices(rows, 'at', 3), L.clocked)}/out")
    last = out.groupBy("device").agg(F.max_by(F.struct(*out.columns[1:]), "blocks").alias("x")).select(F.col("device").cast("long").alias("device"), "x.*").where("blocks > 0")
    return last.withColumns({c: F.round(c, 4) for c in ("drift", "drift_max", "rate")})
