"""Deletion applied to a store that holds all turns: what is left afterwards, and what it counted."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deletion as D
from ..operators import timeline as T
from ..operators.store import Store
from ..sources.views import OBSERVATIONS, observations
from .catalog import query
from .timeline import _window_sql


def filled(spark, sf_dir) -> Store:
    """All turns in a store, in four appends by session, with what answers cite, beliefs on every third turn and their successors, samples, a log and windows."""
    obs, s = observations(spark, sf_dir), Store(spark)
    last = obs.selectExpr("*", "lag(id) over (partition by session order by turn) as prev")
    for k in range(4):
        own, linked = obs.where(f"session % 4 = {k}"), last.where(f"session % 4 = {k}")
        with s.change() as c:
            c.append("observations", own.withColumn("is_question", F.lit(False)))
            c.append("edges", linked.where("kind = 'answer' and prev is not null").selectExpr("id as src", "prev as dst", "'cites' as type", "started_at as at"))
            c.append("beliefs", linked.where("turn % 3 = 0").selectExpr("session * 1000 + turn as id", "session as owner", "text as statement", "person as about", "kind as author", "0.5D as certainty", "1.0D as weight", "started_at as formed_at"))
            c.append("edges", linked.where("turn % 3 = 0").selectExpr("cast(session * 1000 + turn as string) as src", "id as dst", "'came-from' as type", "started_at as at"))
            c.append("uses", own.selectExpr("id", "sha2(concat(person, session % 8, '-', turn), 256) as digest"))
            c.append("log", own.groupBy("session").agg(F.array_sort(F.collect_list("id")).alias("returned")).selectExpr("cast(session as string) as id", "'c' as caller", "returned", "1.0D as at"))
            c.append("windows", T.centred_windows(own))
    with s.change() as c:
        c.append("blobs", c.read("uses").groupBy("digest").agg(F.count("*").alias("bytes"), F.lit(0.0).alias("at")))
    return s


_GONE = f"""{OBSERVATIONS}, l as (select *, lag(id) over (partition by session order by turn) as prev from obs),
cites as (select id as src, prev as dst from l where kind = 'answer' and prev is not null), gone as (select id from obs where session % 8 = 1 and turn = 0 union select src from cites join gone on dst = gone.id),
bel as (select session * 1000 + turn as id, obs.id as src from obs where turn % 3 = 0), gone_bel as (select id from bel where src in (select id from gone)),
uses as (select id, sha256(person || (session % 8)::varchar || '-' || turn::varchar) as digest from obs),
gone_blobs as (select digest from uses group by digest having bool_and(id in (select id from gone))), hit as (select distinct session from obs where id in (select id from gone))"""
_SURVIVING = OBSERVATIONS.replace("from conversations)", "from conversations where printf('%08d-%04d', conv_id, turn) not in (select id from gone))").replace("obs as (", "kept as (")
_WINDOWS = _window_sql("obs as (select * from kept)", select="select id, text from windows")


@query(f"""with recursive {_GONE}, {_SURVIVING}, w as ({_WINDOWS})
select 'observation' as kind, id, '' as detail from kept union all select 'belief', id::varchar, '' from bel where id not in (select id from gone_bel)
union all select 'edge', src, dst from cites where src not in (select id from gone) and dst not in (select id from gone) union all select 'edge', id::varchar, src from bel where id not in (select id from gone_bel)
union all select 'use', id, digest from uses where id not in (select id from gone) union all select 'blob', digest, '' from uses where digest not in (select digest from gone_blobs) group by digest
union all select 'log', session::varchar, string_agg(case when o.id in (select id from gone) then 'forgotten' else o.id end, ',' order by o.id) from obs o group by session
union all select 'window', id, md5(text) from w
union all select 'tombstone observation', id, 'asked to' from gone union all select 'tombstone belief', id::varchar, 'asked to' from gone_bel union all select 'tombstone audio', digest, 'asked to' from gone_blobs""")
def memory_forgotten(spark, sf_dir):
    """What a store holds after the first turns of an eighth of the sessions, and all that follows from them, were forgotten."""
    s = filled(spark, sf_dir)
    D.forget(s, observations(spark, sf_dir).where("session % 8 = 1 and turn = 0").select("id"), "asked to", 9.0)
    each = lambda name, kind, id, detail: s.read(name).selectExpr(f"{kind} as kind", f"cast({id} as string) as id", f"{detail} as detail")
    parts = [
        each("observations", "'observation'", "id", "''"), each("beliefs", "'belief'", "id", "''"), each("edges", "'edge'", "src", "dst"), each("uses", "'use'", "id", "digest"), each("blobs", "'blob'", "digest", "''"),
        each("log", "'log'", "id", "array_join(returned, ',')"), each("windows", "'window'", "id", "md5(text)"), each("tombstones", "concat('tombstone ', kind)", "id", "reason"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(f"""with recursive {_GONE}, n as (select (select count(*) from gone) as observations, (select count(*) from gone_bel) as beliefs, (select count(*) from gone_blobs) as blobs, (select count(*) from hit) as log,
  (select count(*) from gone) as windows_dropped, (select count(*) from obs where session in (select session from hit) and id not in (select id from gone)) as windows_rebuilt)
select 'forgotten' as step, unnest(['observations', 'beliefs', 'blobs', 'log', 'windows_dropped', 'windows_rebuilt']) as what, unnest([observations, beliefs, blobs, log, windows_dropped, windows_rebuilt]) as n from n
union all select 'again', unnest(['observations', 'beliefs', 'blobs', 'log', 'windows_dropped', 'windows_rebuilt']), 0
union all select 'swept', unnest(['blobs', 'bytes']), unnest([count(*), coalesce(sum(b), 0)]) from (select count(*) as b from (select * from uses where id not in (select id from gone)) group by digest having bool_and(id[-1:] = '5'))""")
def memory_deletions(spark, sf_dir):
    """What forgetting counted, that it finds nothing a second time, and what a sweep frees after the uses of all sixth turns are gone."""
    s, rows = filled(spark, sf_dir), []
    seed = observations(spark, sf_dir).where("session % 8 = 1 and turn = 0").select("id")
    for step in ("forgotten", "again"):
        rows += [(step, k, v) for k, v in D.forget(s, seed, "asked to", 9.0).items()]
    with s.change() as c:
        c.rewrite("uses", lambda u: u.where("id like '%5'"), lambda u: u.where("id not like '%5'"))
    rows += [("swept", k, v) for k, v in D.sweep(s, 10_000.0, apply=True).items()]
    return spark.createDataFrame(rows, "step string, what string, n long")
