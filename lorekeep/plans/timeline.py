"""Windows, neighbourhoods, episodes, runs and overlaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prosody as P
from ..operators import timeline as T
from ..sources.views import OBSERVATIONS, WORDS, observations, table, words
from .catalog import query


def _window_sql(rows: str, target: int = 40, most: int = 9, select: str = "select * from windows") -> str:
    """Growth as a recursion with one attempt a step, left on even steps, right on odd ones."""
    return f"""with recursive {rows},
s as (select *, len(regexp_extract_all(text, '\\S+')) as w, row_number() over (partition by session order by started_at, id) as rn from obs),
g as (select id, session, rn as l, rn as r, w as words, true as lo, true as ro, 0 as k from s
  union all
  select g.id, g.session, case when ok and k % 2 = 0 then l - 1 else l end, case when ok and k % 2 = 1 then r + 1 else r end, case when ok then words + nw else words end,
    case when k % 2 = 0 and not ok then false else lo end, case when k % 2 = 1 and not ok then false else ro end, k + 1
  from (select g.*, n.w as nw, coalesce(case when k % 2 = 0 then lo and e.started_at - n.ended_at <= 8 else ro and n.started_at - e.ended_at <= 8 end, false) as ok
    from g left join s n on n.session = g.session and n.rn = case when k % 2 = 0 then l - 1 else r + 1 end join s e on e.session = g.session and e.rn = case when k % 2 = 0 then l else r end
    where (lo or ro) and words < {target} and r - l + 1 < {most}) g),
f as (select id, session, max_by(l, k) as l, max_by(r, k) as r from g group by id, session),
windows as (select f.id, f.session, min_by(s.id, s.rn) as first_id, max_by(s.id, s.rn) as last_id, count(*) as n_obs, min(s.started_at) as started_at, max_by(s.ended_at, s.rn) as ended_at, string_agg(trim(s.text), ' ' order by s.rn) as text
  from f join s on s.session = f.session and s.rn between f.l and f.r group by f.id, f.session)
{select}"""


_COLUMNS = "select id, session, first_id, last_id, n_obs, len(regexp_extract_all(text, '\\S+')) as n_words, started_at, ended_at, text from windows"


@query(_window_sql(OBSERVATIONS, select=_COLUMNS))
def centred_windows(spark, sf_dir):
    return T.centred_windows(observations(spark, sf_dir))


@query(_window_sql(OBSERVATIONS, 140, 7, _COLUMNS))
def centred_windows_wide(spark, sf_dir):
    return T.centred_windows(observations(spark, sf_dir), 140, 7)


@query(_window_sql(OBSERVATIONS.replace("from conversations)", "from conversations where not (conv_id % 3 = 0 and turn = 2))"), select=_COLUMNS))
def window_repair(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return T.repaired_windows(T.centred_windows(obs), obs, obs.where("session % 3 = 0 and turn = 2"))


@query(f"""with {OBSERVATIONS}, s as (select *, len(regexp_extract_all(text, '\\S+')) as w from obs),
n as (select id, w, started_at, ended_at, lag(id) over o as pi, lag(w) over o as pw, lag(ended_at) over o as pe, lead(id) over o as ni, lead(w) over o as nw, lead(started_at) over o as ns from s window o as (partition by session order by started_at, id)),
l as (select *, coalesce(started_at - pe <= 8 and w + pw <= 120, false) as lf from n),
r as (select *, coalesce(ns - ended_at <= 8 and w + case when lf then pw else 0 end + nw <= 120, false) as rf from l)
select id, case when lf then pi end as prev_id, case when rf then ni end as next_id, case when lf then round(started_at - pe, 3) end as gap_before, case when rf then round(ns - ended_at, 3) end as gap_after from r""")
def neighbourhood_gaps(spark, sf_dir):
    return T.neighbourhood(observations(spark, sf_dir))


_EPISODES = f"""with {WORDS}, e as (select id, speaker, "end" as s, "end" + 1 as e, "end" - (lag("end") over (partition by speaker order by "end", id) + 1) > 21600 as b from words),
r as (select *, sum(case when b then 1 else 0 end) over (partition by speaker order by s, id rows unbounded preceding) as run from e),
p as (select *, (row_number() over (partition by speaker, run order by s, id) - 1) // 4 as part from r)"""


def _episodes(spark, sf_dir):
    rows = words(spark, sf_dir).selectExpr("id", "speaker", "end as started_at", "end + 1 as ended_at")
    return T.episodes(rows, 21600, ["speaker"], 4)


@query(_EPISODES + "select speaker, cast(run as bigint) as run, cast(part as bigint) as part, count(*) as n, min(s) as started_at, max(e) as ended_at from p group by all")
def episodes_gap(spark, sf_dir):
    e = _episodes(spark, sf_dir).groupBy("speaker", F.col("run").cast("long").alias("run"), F.col("part").cast("long").alias("part"))
    return e.agg(F.count("*").alias("n"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"))


@query(f"""with {OBSERVATIONS}, s as (select *, len(regexp_extract_all(text, '\\S+')) as w from obs),
c as (select *, sum(w) over (partition by session order by started_at, id rows unbounded preceding) as c from s)
select session, count(*) as n, cast(sum(w) as bigint) as words, string_agg(trim(text), chr(10) order by started_at, id) as text from c where c <= 120 group by session""")
def episode_text_prefix(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("w", T.word_count("text").cast("long"))
    kept = T.prefix_within(rows, ["session"], ["started_at", "id"], F.col("w"), 120)
    lines = F.array_sort(F.collect_list(F.struct("started_at", "id", F.trim("text").alias("t"))))
    return kept.groupBy("session").agg(F.count("*").alias("n"), F.sum("w").alias("words"), F.array_join(F.transform(lines, lambda r: r["t"]), "\n").alias("text"))


@query(f"""with {OBSERVATIONS}, s as (select *, len(regexp_extract_all(text, '\\S+')) as w, max(started_at) over (partition by session) - 20 * 60 as since from obs where kind = 'speech'),
n as (select * from s where started_at >= since qualify row_number() over (partition by session order by started_at desc, id desc) <= 60),
c as (select *, sum(w) over (partition by session order by started_at desc, id desc rows unbounded preceding) as c from n) select id, session, w as words from c where c <= 400""")
def recent_context_budget(spark, sf_dir):
    """Of each session the speech of its last 20 minutes, its newest 60 lines, of these the newest within 400 words."""
    rows = observations(spark, sf_dir).where("kind = 'speech'").withColumn("w", T.word_count("text").cast("long"))
    near = rows.withColumn("since", F.expr("max(started_at) over (partition by session) - 20 * 60")).where("started_at >= since")
    newest = near.withColumn("k", F.expr("row_number() over (partition by session order by started_at desc, id desc)")).where("k <= 60")
    kept = T.prefix_within(newest, ["session"], [F.desc("started_at"), F.desc("id")], F.col("w"), 400)
    return kept.select("id", "session", F.col("w").alias("words"))


_RUNS = f"""{WORDS}, f as (select id, speaker, "end" as t, loud < 75 as q from words),
c as (select *, coalesce(q <> lag(q) over (partition by speaker order by t, id), false) as x from f),
i as (select *, sum(case when x then 1 else 0 end) over (partition by speaker order by t, id rows unbounded preceding) as i from c),
runs as (select speaker, min(t) as t0, max(t) as t1, count(*) as n from i where q group by speaker, i having max(t) - min(t) >= 3600)"""


def _runs(spark, sf_dir):
    return T.runs_below(words(spark, sf_dir).selectExpr("id", "speaker", "end as t", "loud"), ["speaker"], F.col("loud") < 75, 3600)


@query(f"with {_RUNS} select * from runs")
def silence_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


@query(f"""with {_RUNS}, b as (select speaker, min(t) as lo, max(t) as hi from f group by speaker),
x as (select r.speaker, coalesce(lag(t1) over (partition by r.speaker order by t0), lo) as s, t0 as e from runs r join b using (speaker)
  union all select b.speaker, coalesce(m, lo), hi from b left join (select speaker, max(t1) as m from runs group by speaker) using (speaker))
select speaker, s, e from x where e - s >= 60""")
def speech_region_complement(spark, sf_dir):
    bounds = words(spark, sf_dir).groupBy("speaker").agg(F.min("end").alias("lo"), F.max("end").alias("hi"))
    return T.complement(_runs(spark, sf_dir), ["speaker"], bounds, 60)


def _slide(spoken):
    regions = spoken.groupBy("speaker").agg(F.min("end").alias("s"), F.max("end").alias("e"))
    return T.sliding(regions, ["speaker"], 86400.0, 43200.0)


@query(f"""with {WORDS}, b as (select speaker, min("end") as s, max("end") as e from words group by speaker), n as (select *, cast(floor((e - s - 86400) / 43200) as bigint) as n from b)
select speaker, s + k * 43200 as a, s + k * 43200 + 86400 as b from (select *, unnest(generate_series(0, n)) as k from n where n >= 0)
union all select speaker, e - 86400, e from n where n >= 0 and e - (s + n * 43200 + 86400) > 1e-6
union all select speaker, s, e from n where n < 0""")
def sliding_windows(spark, sf_dir):
    return _slide(words(spark, sf_dir))


@query(f"""with {WORDS}, w as (select id, speaker, kind as label, "end" as a, "end" + 20000 as b from words),
x as (select *, case when lag(label) over o <> label or a - lag(b) over o > 5000 then 1 else 0 end as n from w window o as (partition by speaker order by a, id)),
i as (select *, sum(n) over (partition by speaker order by a, id rows unbounded preceding) as i from x)
select speaker, min(a) as a, max(b) as b, min(label) as label, count(*) as n from i group by speaker, i""")
def merge_segments(spark, sf_dir):
    spans = words(spark, sf_dir).selectExpr("id", "speaker", "kind as label", "end as a", "end + 20000 as b")
    return T.merged_segments(spans, ["speaker"], 5000)


_VOTES = f"""with {WORDS}, w as (select id, speaker, "end" - 600 as a, "end" as b from words where kind = 'click'), s as (select speaker, kind as label, "end" - 3000 as c, "end" as d from words where kind <> 'click'),
v as (select w.id, s.label, sum(least(b, d) - greatest(a, c)) as sec from w join s on w.speaker = s.speaker and b > c and a < d group by w.id, s.label)"""


def _votes(spark, sf_dir):
    w = words(spark, sf_dir)
    left = w.where("kind = 'click'").selectExpr("id", "speaker", "end - 600 as a", "end as b")
    right = w.where("kind != 'click'").selectExpr("speaker", "kind as label", "end - 3000 as c", "end as d")
    return T.overlaps(left, right, ["speaker"], 3600)


@query(_VOTES + "select id, min_by(label, (-round(sec, 3), label)) as label, round(sum(sec), 3) as seconds, round(max(sec) / sum(sec), 6) as share from v group by id")
def overlap_vote(spark, sf_dir):
    v = _votes(spark, sf_dir).groupBy("id", "label").agg(F.sum("overlap").alias("sec"))
    return v.groupBy("id").agg(F.min_by("label", F.struct(-F.round("sec", 3), "label")).alias("label"), F.round(F.sum("sec"), 3).alias("seconds"), F.round(F.max("sec") / F.sum("sec"), 6).alias("share"))


@query(_VOTES.replace("v as (select w.id, s.label,", "v as (select w.id, any_value(s.label) as label,").replace("group by w.id, s.label)", "group by w.id)") + "select w.id, round(coalesce(sec, 0) / 600, 6) as share, coalesce(sec, 0) / 600 >= 0.5 as drop from w left join v on w.id = v.id")
def self_heard_overlap(spark, sf_dir):
    """Utterances of which own speech covers half or more; overlaps with several windows add up."""
    share = _votes(spark, sf_dir).groupBy("id").agg((F.sum("overlap") / 600).alias("s"))
    rows = words(spark, sf_dir).where("kind = 'click'").select("id").join(share, "id", "left")
    return rows.select("id", F.round(F.coalesce("s", F.lit(0.0)), 6).alias("share"), (F.coalesce("s", F.lit(0.0)) >= 0.5).alias("drop"))


@query(f"""with recursive {WORDS}, o as (select speaker, value, row_number() over (partition by speaker order by "end", id) as k from words),
f as (select speaker, k, value as level from o where k = 1 union all select f.speaker, o.k, level + 0.05 * (o.value - level) from f join o on o.speaker = f.speaker and o.k = f.k + 1)
select speaker, max(k) as n, round(max_by(level, k), 6) as level from f group by speaker""")
def ewma_levels(spark, sf_dir):
    return P.ewma(words(spark, sf_dir), "speaker")


@query("""with d as (select user_id, max(case when event_type = 'purchase' then cast(ts as date) end) as marker from events group by user_id), t as (select max(cast(ts as date)) as today from events),
p as (select user_id, marker, cast(today - 1 as date) as last, case when marker is null then cast(today - 1 as date) else cast(marker + 1 as date) end as first from d, t),
x as (select user_id, greatest(datediff('day', first, last) + 1 - 5, 0) as skipped, first, last from p where first <= last)
select user_id, cast(unnest(generate_series(cast(first + cast(skipped as integer) as timestamp), cast(last as timestamp), interval 1 day)) as date) as day, cast(skipped as integer) as skipped from x""")
def pending_days(spark, sf_dir):
    """For each user the days after its marker (its last purchase) up to the day before the table's last, the last five of them, and how many older ones were skipped; without a marker that one day."""
    days = table(spark, sf_dir, "events").selectExpr("user_id", "event_type", "to_date(ts) as day")
    markers = days.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("day"))).alias("marker"))
    return T.pending(markers, "user_id", days.agg(F.max("day")).first()[0], 5)
