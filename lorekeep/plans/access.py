"""Governance: admission, release, presence, logs, budgets, liveness, configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import REQUEST_WORDS
from ..operators import governance as G
from ..sources.views import epoch, table
from .catalog import query

_NOW = 1704500000.0


def _callers(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as caller", "c_mktsegment <> 'BUILDING' as can_read", "c_acctbal > 5000 as can_write")


def _requests(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id as id", "user_id * 11 as caller", "case event_type when 'purchase' then 'write_belief' when 'click' then 'record_answer' else 'search_memory' end as tool")


@query("""with r as (select event_id as id, user_id * 11 as caller, case event_type when 'purchase' then 'write_belief' when 'click' then 'record_answer' else 'search_memory' end as tool from events)
select id, caller, tool, case when c_custkey is null then 'unknown' when tool <> 'search_memory' and not c_acctbal > 5000 then 'may not write' when tool = 'search_memory' and c_mktsegment = 'BUILDING' then 'may not read' else 'ok' end as decision
from r left join customer on c_custkey = caller""")
def admit_decide(spark, sf_dir):
    return G.admitted(_requests(spark, sf_dir), _callers(spark, sf_dir))


@query(f"""with g as (select user_id as caller, event_type as tool, max(epoch(ts) + 86400) as expires_at from events where event_id % 3 = 0 and epoch(ts) + 86400 > {_NOW} and epoch(ts) < {_NOW} group by all)
select event_id as id, case when event_id % 11 = 0 then 'refuse' when event_id % 4 = 0 then 'allow' when expires_at is not null then 'standing' else 'ask' end as release from events left join g on user_id = caller and event_type = tool""")
def release_case(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.expr(epoch("ts")))
    requests = e.selectExpr("event_id as id", "user_id as caller", "event_type as tool", "event_id % 11 = 0 as stale", "if(event_id % 4 = 0, 'off', 'on') as mode")
    grants = e.where(f"event_id % 3 = 0 and at < {_NOW}").selectExpr("user_id as caller", "event_type as tool", "at + 86400 as expires_at")
    return G.released(requests, grants, _NOW)


@query(f"""with e as (select event_type as place, case when user_id % 3 = 0 then null else user_id end as person from events where epoch(ts) between {_NOW} - 900 and {_NOW})
select place, count(distinct person) as people, count(*) - count(person) as unknown, case when count(distinct person) + count(*) - count(person) = 0 then 'no evidence' when count(distinct person) = 1 and count(*) = count(person) then 'alone' else 'accompanied' end as state from e group by place""")
def presence_state(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_type as place", f"{epoch('ts')} as at", "if(user_id % 3 = 0, null, user_id) as person")
    return G.presence(rows, _NOW, 900.0)


_REQ = "[" + ", ".join(f"'{w}'" for w in REQUEST_WORDS) + "]"


_SAID = "case turn % 5 when 1 then array_to_string(regexp_extract_all(text, '\\S+')[1:3], ' ') when 2 then 'Show me ' || text when 3 then text || '?' else text end"


@query(f"""with said as (select conv_id, turn, {_SAID} as text from conversations) select conv_id * 100 + turn as id, case when conv_id % 13 = 0 then 'paused' when len(regexp_extract_all(text, '\\S+')) < 4 then 'short'
  when not (list_contains({_REQ}, lower(regexp_extract(text, '^\\s*([A-Za-z'']+)', 1))) or regexp_matches(text, '\\?\\s*$')) then 'no request' when (conv_id + turn) % 2 = 1 then 'unrecognised' else 'ask the model' end as rung from said""")
def addressed_ladder(spark, sf_dir):
    """Turns as they are, cut to three words, or turned into requests and questions, as few of them ask for anything."""
    words = F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(0))
    k = F.col("turn") % 5
    said = F.when(k == 1, F.array_join(F.slice(words, 1, 3), " ")).when(k == 2, F.concat(F.lit("Show me "), "text")).when(k == 3, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select(F.expr("conv_id * 100 + turn as id"), said.alias("text"), F.expr("conv_id % 13 = 0 as paused"), F.expr("(conv_id + turn) % 2 = 0 as recognised"))
    return G.addressed(rows)


@query("select event_id as id, user_id as caller, 'k=' || json_extract_string(props, '$.k') || ';tool=' || event_type as arguments from events")
def access_log_shape(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    args = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "secret": "x", "caller": "y", "tool": "'), "event_type", F.lit('"}'))
    return G.shaped_log(e.select(F.col("event_id").alias("id"), F.col("user_id").alias("caller"), args.alias("arguments")))


@query("select event_type as provider, cast(ts as date) as day, count(*) as calls, cast(sum(cast(value * 100 as bigint)) as bigint) as tokens, round(sum(value), 4) as cost, count(*) >= 200 or sum(cast(value * 100 as bigint)) >= 300000 as halted from events group by 1, 2")
def spend_by_day(spark, sf_dir):
    calls = table(spark, sf_dir, "events").selectExpr("event_type as provider", "to_date(ts) as day", "cast(round(value * 100) as bigint) as tokens", "value as cost")
    return G.spend(calls)


@query("select user_id as pid, round(max(epoch(ts)), 3) as last_seen, count(*) as beats, 1706659000 - max(epoch(ts)) < 90 * 600 as alive from events group by user_id")
def process_liveness(spark, sf_dir):
    """Heartbeats; here a process is dead after 90 times 600 seconds."""
    beats = table(spark, sf_dir, "events").selectExpr("user_id as pid", f"{epoch('ts')} / 600 as at")
    t = G.liveness(beats, 1706659000.0 / 600)
    return t.select("pid", F.round(F.col("last_seen") * 600, 3).alias("last_seen"), "beats", "alive")


@query("""with a as (select p_partkey as k, p_brand as v from part where p_partkey % 7 <> 0), b as (select p_partkey as k, case when p_partkey % 5 = 0 then p_type else p_brand end as v from part where p_partkey % 11 <> 0)
select coalesce(a.k, b.k) as key, a.v as old, b.v as new from a full join b on a.k = b.k where a.v is distinct from b.v""")
def config_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.where("p_partkey % 7 != 0").selectExpr("p_partkey as key", "p_brand as value")
    b = p.where("p_partkey % 11 != 0").selectExpr("p_partkey as key", "if(p_partkey % 5 = 0, p_type, p_brand) as value")
    return G.differences(a, b)


@query("""with r as (select event_id, user_id, event_type = 'error' or value < 20 as bad, row_number() over (partition by user_id order by ts, event_id) as k from events),
i as (select *, k - row_number() over (partition by user_id, bad order by k) as g from r)
select user_id, max(n) as longest_run, cast(sum(case when n >= 2 then 1 else 0 end) as bigint) as unhealthy from (select user_id, g, count(*) as n from i where bad group by user_id, g) group by user_id""")
def consecutive_failures(spark, sf_dir):
    """Runs of failed outcomes in each caller's order; two in a row make it unhealthy."""
    rows = table(spark, sf_dir, "events").selectExpr("user_id", "event_type = 'error' or value < 20 as bad", "row_number() over (partition by user_id order by ts, event_id) as k")
    runs = rows.selectExpr("user_id", "bad", "k - row_number() over (partition by user_id, bad order by k) as g").where("bad").groupBy("user_id", "g").agg(F.count("*").alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest_run"), F.sum((F.col("n") >= 2).cast("long")).alias("unhealthy"))
