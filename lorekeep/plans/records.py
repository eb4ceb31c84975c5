"""Beliefs, provenance, deletion and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import beliefs as B
from ..operators import forget as G
from ..sources.views import BELIEFS, NEWEST, OBSERVATIONS, REPLACES, beliefs, epoch, newest, observations, replaces, table
from .catalog import query


def _sources(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as belief_id", "l_orderkey * 10 + l_linenumber as source_id")


@query(f"with {BELIEFS} select about, count(*) as n, round(min(formed_at), 3) as first_at, round(max(formed_at), 3) as last_at from beliefs group by about")
def about_census(spark, sf_dir):
    return beliefs(spark, sf_dir).groupBy("about").agg(F.count("*").alias("n"), F.round(F.min("formed_at"), 3).alias("first_at"), F.round(F.max("formed_at"), 3).alias("last_at"))


@query(f"with {BELIEFS} select about, author, count(*) as n, round(avg(certainty), 6) as certainty from beliefs group by rollup (about, author)")
def about_author_rollup(spark, sf_dir):
    return beliefs(spark, sf_dir).rollup("about", "author").agg(F.count("*").alias("n"), F.round(F.avg("certainty"), 6).alias("certainty"))


@query(f"with {BELIEFS}, {REPLACES} select 'came-from' as type, count(*) as n from lineitem union all select 'replaces', count(*) from replaces")
def edge_type_census(spark, sf_dir):
    edges = _sources(spark, sf_dir).select(F.lit("came-from").alias("type")).union(replaces(beliefs(spark, sf_dir)).select(F.lit("replaces")))
    return edges.groupBy("type").agg(F.count("*").alias("n"))


@query(f"""with recursive {BELIEFS}, {REPLACES}, c as (select id, id as cur, 0 as hops from beliefs union all select c.id, r.src_id, hops + 1 from c join replaces r on r.dst_id = c.cur)
select id, max_by(cur, hops) as current, cast(max(hops) as bigint) as hops from c group by id""")
def current_version_chain(spark, sf_dir):
    b = beliefs(spark, sf_dir)
    return B.current_versions(b, replaces(b)).select("id", "current", "hops")


@query(f"with {BELIEFS}, {REPLACES} select dst_id as id, min(src_id) as replaced_by from replaces group by dst_id")
def replaced_by_lookup(spark, sf_dir):
    return replaces(beliefs(spark, sf_dir)).groupBy(F.col("dst_id").alias("id")).agg(F.min("src_id").alias("replaced_by"))


@query(f"with {BELIEFS} select id, about from beliefs b where not exists (select 1 from lineitem where l_orderkey = b.id)")
def beliefs_without_provenance(spark, sf_dir):
    return B.without_provenance(beliefs(spark, sf_dir), _sources(spark, sf_dir)).select("id", "about")


@query("select l_orderkey as belief_id, l_orderkey * 10 + l_linenumber as source_id from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')")
def dangling_provenance(spark, sf_dir):
    """Sources whose belief is gone; as if those of status P had been deleted."""
    left = beliefs(spark, sf_dir).where("author != 'P'").select(F.col("id").alias("belief_id"))
    return _sources(spark, sf_dir).join(left, "belief_id", "left_anti").select("belief_id", "source_id")


@query(f"""with {BELIEFS}, {REPLACES}, s as (select l_orderkey as id, string_agg(lpad(cast(l_orderkey * 10 + l_linenumber as varchar), 12, '0'), ',' order by lpad(cast(l_orderkey * 10 + l_linenumber as varchar), 12, '0')) as sources from lineitem group by l_orderkey)
select id, about, certainty, coalesce(sources, '') as sources, coalesce(cast(dst_id as varchar), '') as replaces from beliefs left join s using (id) left join replaces on src_id = id""")
def derivations(spark, sf_dir):
    b = beliefs(spark, sf_dir)
    return B.derivations(b, _sources(spark, sf_dir), replaces(b))


@query("select cast(o_orderkey as bigint) as id, o_orderpriority as about, 'only_before' as side from orders where o_orderkey % 97 = 0")
def rebuild_identity(spark, sf_dir):
    """What a rebuild lost or added; as if it had lost every 97th belief."""
    b = beliefs(spark, sf_dir).select("id", "about")
    return B.multiset_difference(b, b.where("id % 97 != 0"))


@query(f"with {BELIEFS} select id, round(weight * pow(0.5, greatest({NEWEST} - formed_at, 0) / 86400 / 30.0), 6) as weight_now, weight * pow(0.5, greatest({NEWEST} - formed_at, 0) / 86400 / 30.0) < 0.05 as faint from beliefs")
def decay_weights(spark, sf_dir):
    b = beliefs(spark, sf_dir)
    w = B.decayed(F.col("weight"), F.col("formed_at"), F.lit(newest(b)))
    return b.select("id", F.round(w, 6).alias("weight_now"), (w < B.FAINT).alias("faint"))


@query(f"""with recursive {BELIEFS}, o as (select owner, formed_at as tm, row_number() over (partition by owner order by formed_at) as k from beliefs),
f as (select owner, k, tm, cast(1.25 as double) as w from o where k = 1 union all
  select f.owner, o.k, o.tm, least(f.w * pow(0.5, greatest(o.tm - f.tm, 0) / 86400 / 30.0) + 0.25, 4.0) from f join o on o.owner = f.owner and o.k = f.k + 1)
select owner, round(max_by(w, k), 6) as weight, max_by(tm, k) as last_touched, max(k) as times_returned from f group by owner""")
def touch_fold(spark, sf_dir):
    return B.touch_fold(beliefs(spark, sf_dir).select("owner", F.col("formed_at").alias("at")), "owner")


@query(f"""with {BELIEFS}, {REPLACES}, w as (select *, weight * pow(0.5, greatest({NEWEST} - formed_at, 0) / 86400 / 30.0) as x from beliefs)
select id, certainty, round(x, 6) as weight_now, formed_at from w where certainty >= 0.6 and x >= 0.05 and id not in (select dst_id from replaces) order by formed_at desc, id desc limit 8""")
def belief_context(spark, sf_dir):
    b = beliefs(spark, sf_dir)
    return B.shown(b, replaces(b).select(F.col("dst_id").alias("id")), newest(b))


_CITES = f"""{OBSERVATIONS}, cites as (select id as src, prev as dst from (select id, kind, session, lag(id) over (partition by session order by started_at, id) as prev from obs) where prev is not null and (kind = 'answer' or session % 2 = 0)),
gone as (select id from obs where session % 5 = 0 and turn = 1 union select c.src from gone join cites c on c.dst = gone.id)"""


def _cites(obs):
    order = "partition by session order by started_at, id"
    return obs.selectExpr("id as src", f"lag(id) over ({order}) as dst", "kind", "session").where("dst is not null and (kind = 'answer' or session % 2 = 0)").select("src", "dst")


def _gone(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return G.closure(obs.where("session % 5 = 0 and turn = 1"), _cites(obs))


@query(f"with recursive {_CITES} select id from gone")
def forget_closure(spark, sf_dir):
    return _gone(spark, sf_dir)


@query(f"""with recursive {_CITES}, uses as (select id, sha256(person || cast(session % 7 as varchar) || cast(turn as varchar)) as digest from obs)
select digest, count(*) as uses from uses group by digest having bool_and(id in (select id from gone))""")
def forget_plan_blobs(spark, sf_dir):
    uses = observations(spark, sf_dir).select("id", F.expr("sha2(concat(person, cast(session % 7 as string), cast(turn as string)), 256)").alias("digest"))
    return G.exclusive_blobs(uses, _gone(spark, sf_dir))


@query(f"""with recursive {_CITES}, log as (select session as key, list(id order by id) as ids from obs group by session)
select key, array_to_string(list_transform(ids, lambda x: case when x in (select id from gone) then 'forgotten' else x end), ',') as returned, cast(len(list_filter(ids, lambda x: x in (select id from gone))) as bigint) as n_scrubbed from log""".replace(
    "list_transform(ids, lambda x: case when x in (select id from gone) then 'forgotten' else x end)", "list_transform(ids, lambda x: case when list_contains(g, x) then 'forgotten' else x end)"
).replace("list_filter(ids, lambda x: x in (select id from gone))", "list_filter(ids, lambda x: list_contains(g, x))").replace("from log", "from log, (select list(id) as g from gone)"))
def forget_apply_scrub(spark, sf_dir):
    log = observations(spark, sf_dir).groupBy(F.col("session").alias("key")).agg(F.array_sort(F.collect_list("id")).alias("returned"))
    return G.scrub_log(log, _gone(spark, sf_dir))


@query("select sha256(text) as digest, count(*) as copies, cast(sum(strlen(text)) as bigint) as bytes, min(doc_id) as first_id from documents group by 1")
def blob_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").cast("long").alias("b"))
    return rows.groupBy("digest").agg(F.count("*").alias("copies"), F.sum("b").alias("bytes"), F.min("doc_id").alias("first_id"))


@query("""with b as (select sha256(text) as digest, strlen(text) as bytes, cast(1000 * min(doc_id) as double) as since from documents group by 1, 2), u as (select distinct sha256(text) as digest from documents where source <> 'src1')
select digest, bytes, since from b where digest not in (select digest from u) and 500000 - since > 3600""")
def orphan_blobs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    blobs = rows.groupBy("digest", "bytes").agg((1000.0 * F.min("doc_id")).alias("at"))
    return G.orphans(blobs, rows.where("source != 'src1'"), 500000.0).select("digest", "bytes", F.col("at").alias("since"))


@query("select user_id, max(event_id) as event_id, max_by(event_type, (ts, event_id)) as state, round(max_by(value, (ts, event_id)), 6) as value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1 group by user_id")
def latest_capture_state(spark, sf_dir):
    rows = G.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "value"])
    return rows.select("user_id", "event_id", F.col("event_type").alias("state"), F.round("value", 6).alias("value"))


@query("select user_id, event_type as kind, count(*) as n, max(event_id) as last_id from events group by user_id, event_type")
def tombstone_latest(spark, sf_dir):
    """Every event as a deletion: what is left of each kind is a count and the last id."""
    gone = table(spark, sf_dir, "events")
    return gone.groupBy("user_id", F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query("select c_custkey as id, case when c_custkey % 10 = 3 then 'NEW' else c_mktsegment end as segment from customer union all select 10000000 + n_nationkey, 'ADDED' from nation")
def upsert_latest(spark, sf_dir):
    base = table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as bigint) as id", "c_mktsegment as segment")
    changed = base.where("id % 10 = 3").select("id", F.lit("NEW").alias("segment"))
    added = table(spark, sf_dir, "nation").selectExpr("cast(10000000 + n_nationkey as bigint) as id", "'ADDED' as segment")
    return G.upsert(base, changed.union(added), ["id"])


def _prefixes(events):
    rows = events.selectExpr("event_id", f"cast(round({epoch('ts')} * 1000) as bigint) as ms")
    own, usual = "ABCDEFGHJKMNPQRSTVWXYZ", "ABCDEFGHIJKLMNOPQRSTUV"
    prefix = F.translate(F.lpad(F.conv(F.col("ms").cast("string"), 10, 32), 10, "0"), usual, own)
    return rows.select("event_id", prefix.alias("prefix")).withColumn("decoded", F.conv(F.translate("prefix", own, usual), 32, 10).cast("long"))


@query("""with i as (select event_id, cast(round(epoch(ts) * 1000) as bigint) as ms from events),
d as (select event_id, ms, unnest(generate_series(0, 9)) as k from i)
select event_id, string_agg(substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', cast((ms // cast(pow(32, 9 - k) as bigint)) % 32 as integer) + 1, 1), '' order by k) as prefix, ms as decoded from d group by event_id, ms""")
def ulid_prefix(spark, sf_dir):
    """The ten time characters of a sortable id, and their value read back."""
    return _prefixes(table(spark, sf_dir, "events"))
