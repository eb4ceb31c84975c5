"""Look-ups with fallbacks, states of approvals, routes, reports, cuts, logs of silence, fingerprints of tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import forget as G
from ..operators import prosody as P
from ..sources.views import BELIEFS, OBSERVATIONS, REPLACES, WORDS, beliefs, observations, replaces, table, words
from .catalog import query


@query("""select l_orderkey as belief_id, l_linenumber as line, case when o.o_orderkey is not null and o_orderstatus <> 'P' then o_orderpriority when o.o_orderkey is not null then 'deleted: retention' else 'missing' end as source
from lineitem left join (select * from orders where o_orderkey % 20 <> 0) o on o.o_orderkey = l_orderkey""")
def source_or_tombstone(spark, sf_dir):
    """Sources that resolve to a belief, else to the reason of their tombstone, else to nothing."""
    kept = table(spark, sf_dir, "orders").where("o_orderkey % 20 != 0")
    live = kept.where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("belief_id"), F.col("o_orderpriority").alias("a"))
    tombs = kept.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("belief_id"), F.lit("deleted: retention").alias("t"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("belief_id"), F.col("l_linenumber").alias("line"))
    return rows.join(live, "belief_id", "left").join(tombs, "belief_id", "left").select("belief_id", "line", F.coalesce("a", "t", F.lit("missing")).alias("source"))


@query("""with e as (select event_id % 500 as approval, ts, event_id, case when event_type = 'purchase' then 'approved' when event_type = 'click' then 'denied' else 'pending' end as state from events),
f as (select approval, arg_min(state, (ts, event_id)) as state from e where state <> 'pending' group by approval), n as (select approval, count(*) as n from e group by approval)
select n.approval, coalesce(f.state, 'pending') as state, n from n left join f using (approval)""")
def approval_states(spark, sf_dir):
    """Approvals leave the pending state once; later decisions change nothing."""
    state = "case event_type when 'purchase' then 'approved' when 'click' then 'denied' else 'pending' end"
    rows = table(spark, sf_dir, "events").selectExpr("event_id % 500 as approval", "ts", "event_id", f"{state} as state")
    first = F.min_by(F.when(F.col("state") != "pending", F.col("state")), F.when(F.col("state") != "pending", F.struct("ts", "event_id")))
    return rows.groupBy("approval").agg(F.coalesce(first, F.lit("pending")).alias("state"), F.count("*").alias("n"))


@query("""with p as (select s_suppkey as provider, s_nationkey as capability, s_acctbal > 0 as available, row_number() over (partition by s_nationkey, s_acctbal > 0 order by s_acctbal desc, s_suppkey) as k from supplier)
select n_nationkey as capability, p.provider from nation left join p on p.capability = n_nationkey and available and k = 1""")
def provider_routes(spark, sf_dir):
    """For each capability the first available provider in order, null if none is."""
    p = table(spark, sf_dir, "supplier").where("s_acctbal > 0")
    first = p.groupBy(F.col("s_nationkey").alias("capability")).agg(F.min_by("s_suppkey", F.struct(-F.col("s_acctbal"), "s_suppkey")).alias("provider"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("capability")).join(first, "capability", "left")


@query("""select event_type as category, count(*) as n, round(avg(case when value > 50 then 1.0 else 0.0 end), 6) as rate, round(avg(value), 6) as score from events group by grouping sets ((event_type), ())""")
def category_report(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), "value")
    return rows.groupingSets([[F.col("category")], []], "category").agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("rate"), F.round(F.avg("value"), 6).alias("score"))


@query(f"""with {WORDS}, w as (select speaker % 10 as grp, loud as w from words), m as (select grp, median(w) as m from w group by grp),
x as (select w.grp, m, case when w > m then w else 2 * m - w end as x, w > m as r from w join m using (grp)),
g as (select grp, m, unnest(generate_series(0, 60000)) as j from m),
c as (select grp, m, cast(ceil(round((x - m) / 0.001, 6)) as bigint) as k, r from x),
h as (select grp, k, count(*) filter (r) as r, count(*) filter (not r) as l from c group by grp, k),
s as (select g.grp, g.m, g.j, sum(h.r) over (partition by g.grp order by g.j desc rows between unbounded preceding and 1 preceding) as R, sum(h.l) over (partition by g.grp order by g.j desc rows between unbounded preceding and 1 preceding) as L from g left join h on h.grp = g.grp and h.k = g.j),
e as (select *, R - L as ex from (select grp, m, j, coalesce(R, 0) as R, coalesce(L, 0) as L from s)),
a as (select grp, min(j) as lj, min_by(ex, j) as lx from e where R > 0 and ex * 2 >= R group by grp),
b as (select e.grp, min(j) as sj from e join a using (grp) where j >= lj and ex * 2 <= lx group by e.grp)
select m.grp, round(m, 6) as median, round(m + lj * 0.001, 6) as light, round(m + sj * 0.001, 6) as strong from m left join a using (grp) left join b using (grp)""")
def level_cuts(spark, sf_dir):
    w = words(spark, sf_dir).selectExpr("speaker % 10 as grp", "loud as w")
    return P.derived_levels(w, "grp")


@query(f"""with {WORDS}, w as (select speaker as key, id, "end" - 1800 as s, "end" as e from words where kind = 'click'), f as (select speaker as key, "end" as t, pitch, loud as level from words)
select w.id, count(pitch) as n_voiced, round(quantile_cont(pitch, 0.5), 6) as pitch_med, round(quantile_cont(level, 0.9), 6) as int_p90, round(avg(level), 6) as int_mean from w left join f on w.key = f.key and t >= s and t <= e group by w.id""")
def word_measures(spark, sf_dir):
    w = words(spark, sf_dir)
    spans = w.where("kind = 'click'").selectExpr("speaker as key", "id", "end - 1800 as start", "end")
    return P.word_rows(spans, w.selectExpr("speaker as key", "end as t", "pitch", "loud as level"), 3600.0)


@query(f"""with {WORDS}, g as (select speaker as key, id, "end" - lag("end") over o as gap, lag(kind) over o as before, kind as next, pitch < 0.95 * lag(pitch) over o as fell from words window o as (partition by speaker order by "end", id))
select key, id, round(gap, 3) as gap, before, next, fell from g where gap >= 30000""")
def silence_log(spark, sf_dir):
    return P.silence_log(words(spark, sf_dir).selectExpr("speaker as key", "id", "end", "kind as word", "pitch"), 30000.0)


@query(f"""with {WORDS}, u as (select speaker, sentence, string_agg(kind, ' ' order by "end", id) as text, count(*) as n, min("end") as t0, max("end") as t1, bool_or(kind = 'error') as has_error from words group by speaker, sentence)
select *, t0 - lag(t1) over (partition by speaker order by t0) as silence_before from u""")
def utterance_records(spark, sf_dir):
    """One record a sentence: its words in order, its bounds, the silence before it."""
    rows = words(spark, sf_dir).groupBy("speaker", "sentence").agg(
        F.array_sort(F.collect_list(F.struct("end", "id", "kind"))).alias("r"), F.count("*").alias("n"), F.min("end").alias("t0"), F.max("end").alias("t1"), F.bool_or(F.col("kind") == "error").alias("has_error"))
    text = F.array_join(F.transform("r", lambda x: x["kind"]), " ")
    before = F.col("t0") - F.lag("t1").over(W.partitionBy("speaker").orderBy("t0"))
    return rows.select("speaker", "sentence", text.alias("text"), "n", "t0", "t1", "has_error", before.alias("silence_before"))


@query(f"""with {BELIEFS}, {REPLACES}, live as (select * from beliefs where id not in (select dst_id from replaces)), n as (select *, row_number() over (partition by about order by formed_at desc, id desc) as k from live)
select about, id, certainty from n where k = 1""")
def newest_about(spark, sf_dir):
    """The newest belief about each matter that nothing has replaced: what a new one is first compared with."""
    b = beliefs(spark, sf_dir)
    live = b.join(replaces(b).select(F.col("dst_id").alias("id")), "id", "left_anti")
    return G.latest(live, ["about"], ["formed_at", "id"], ["certainty"]).select("about", "id", "certainty")


@query(f"""with {OBSERVATIONS} select session, count(*) as n, sha256(string_agg(id || ':' || sha256(text), chr(10) order by id)) as fingerprint from obs group by session""")
def observation_fingerprints(spark, sf_dir):
    """A digest of each session's observations in order; equal before and after a rebuild."""
    rows = observations(spark, sf_dir).select("session", F.concat("id", F.lit(":"), F.sha2(F.col("text").cast("binary"), 256)).alias("l"), "id")
    lines = F.array_sort(F.collect_list(F.struct("id", "l")))
    return rows.groupBy("session").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(lines, lambda x: x["l"]), "\n"), 256).alias("fingerprint"))
