"""The record store written and read back: appends, checks, views for callers, settings, grants, archives, people."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import archive as A
from ..operators import governance as G
from ..operators import people as P
from ..operators import store as S
from ..operators.store import Store
from ..sources.views import BELIEFS, NEWEST, OBSERVATIONS, REPLACES, beliefs, epoch, newest, observations, replaces, table
from .catalog import query
from .text import _list

_ASKS = f"coalesce(ends_with(lower(trim(text)), '?') or list_contains({_list(fixed.QUESTION_WORDS)}, regexp_extract(lower(trim(text)), '^\\S*')), false)"


def _sources(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.expr("l_orderkey * 10 + l_linenumber")).alias("sources"))


@query(f"with {OBSERVATIONS} select id, kind, session, {_ASKS} as is_question from obs")
def store_observations(spark, sf_dir):
    """All turns appended to a new store and read back from it, opened again with the same settings."""
    s = Store(spark)
    s.open({"embedder": "own", "dimensions": "64"})
    s.add_observations(observations(spark, sf_dir))
    again = Store(spark, s.path)
    again.open({"dimensions": "64", "embedder": "own"})
    return again.read("observations").select("id", "kind", "session", "is_question")


_ANSWERS = f"""{OBSERVATIONS}, known as (select * from obs where kind <> 'answer'), a as (select *, lag(id) over (partition by session order by started_at, id) as prev, lag(kind) over (partition by session order by started_at, id) as prev_kind from obs),
answers as (select id, prev, case when session % 7 = 0 then 'no sources' when prev is null or prev_kind = 'answer' or session % 7 = 1 then 'unknown source' else 'ok' end as reason from a where kind = 'answer')"""


@query(f"with {_ANSWERS} select id, case when reason = 'ok' then prev else '' end as cites, reason from answers")
def store_answers(spark, sf_dir):
    """Answers written with what they cite; those that cite nothing or something unknown are turned away."""
    obs, s = observations(spark, sf_dir), Store(spark)
    s.add_observations(obs.where("kind != 'answer'"))
    order = "partition by session order by started_at, id"
    prev = F.when(F.expr("session % 7 = 0"), F.array().cast("array<string>")).when(F.expr("session % 7 = 1"), F.array(F.lit("nowhere"), F.col("prev"))).otherwise(F.array(F.coalesce("prev", F.lit("nowhere"))))
    answers = obs.selectExpr("*", f"lag(id) over ({order}) as prev").where("kind = 'answer'").withColumn("cites", prev)
    refused = s.add_answers(answers, 1.0).select("id", F.lit("").alias("cites"), "reason")
    return s.read("edges").where("type = 'cites'").select(F.col("src").alias("id"), F.col("dst").alias("cites"), F.lit("ok").alias("reason")).union(refused)


_PROPOSALS = f"""{BELIEFS}, {REPLACES}, n as (select l_orderkey as id, count(distinct l_linenumber) as n from lineitem group by 1), p as (select id, about, coalesce(n, 0) as n, dst_id,
  case when coalesce(n, 0) = 0 then 'no sources' when owner % 50 = 0 then 'no subject' else 'ok' end as reason from beliefs left join n using (id) left join replaces on src_id = id)"""


def _proposals(spark, sf_dir):
    b = beliefs(spark, sf_dir)
    rows = b.join(_sources(spark, sf_dir), "id", "left").join(replaces(b).select(F.col("src_id").alias("id"), F.col("dst_id").alias("replaces")), "id", "left")
    return rows.withColumns({"about": F.when(F.expr("owner % 50 = 0"), F.lit(" ")).otherwise(F.col("about")), "statement": F.concat(F.lit("belief "), F.col("id").cast("string"))})


@query(f"""with {_PROPOSALS} select 'came-from' as what, cast(sum(n) as bigint) as n from p where reason = 'ok' union all select 'replaces', count(dst_id) from p where reason = 'ok'
union all select 'beliefs', count(*) from p where reason = 'ok' union all select reason, count(*) from p where reason <> 'ok' group by reason""")
def store_beliefs(spark, sf_dir):
    """Beliefs written with their edges: what the store then holds, and what was turned away."""
    s = Store(spark)
    refused = s.add_beliefs(_proposals(spark, sf_dir), 1.0).groupBy(F.col("reason").alias("what")).agg(F.count("*").alias("n"))
    return s.edge_types().select(F.col("type").alias("what"), "n").union(s.read("beliefs").agg(F.lit("beliefs").alias("what"), F.count("*").alias("n")).select("what", "n")).union(refused)


@query(f"with {_PROPOSALS} select cast(p.id + 1000000 as varchar) as src, cast(p.dst_id + 1000000 as varchar) as dst from p join p q on p.dst_id = q.id where p.reason = 'ok' and q.reason = 'ok'")
def store_rebuild(spark, sf_dir):
    """The belief layer dropped and built anew under other ids: its replacements afterwards."""
    s = Store(spark)
    s.add_beliefs(_proposals(spark, sf_dir), 1.0)
    kept = s.read("beliefs").select("id", F.col("id").cast("string").alias("key"))  # of this version, whatever comes later
    old = s.read("edges").where("type = 'replaces'").select("src", "dst")
    ids = kept.select(F.col("key").alias("old_id"), (F.col("id") + 1000000).cast("string").alias("new_id"))
    new = Store(spark)
    new.link(S.remapped(kept.select(F.col("key").alias("id")), old, ids), "replaces", 2.0)
    beliefs_gone, edges_gone = s.drop_beliefs()
    if s.read("beliefs").count() or s.read("edges").count() or not beliefs_gone or not edges_gone:
        raise RuntimeError("the layer is still there")
    return new.read("edges").select("src", "dst")


@query(f"""with {BELIEFS}, {REPLACES}, w as (select *, weight * pow(0.5, greatest({NEWEST} - formed_at, 0) / 86400 / 30.0) as x from beliefs), n as (select l_orderkey as id, count(*) as n from lineitem group by 1)
select w.id, about, round(certainty, 3) as certainty, round(x, 3) as weight, x < 0.05 as faint, coalesce(n, 0) as sources, src_id as replaced_by,
  last_value(w.id) over (partition by owner order by formed_at, w.id rows between unbounded preceding and unbounded following) as current from w left join n on n.id = w.id left join replaces on dst_id = w.id""")
def belief_cards(spark, sf_dir):
    b = beliefs(spark, sf_dir)
    sources = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("belief_id"))
    return S.shaped_beliefs(b, sources, replaces(b), newest(b))


@query(f"""with {OBSERVATIONS} select id, case when session % 5 = 0 and turn = 1 then null else person end as person, case when session % 5 = 0 and turn = 1 then null else text end as text,
  turn % 3 <> 0 and not (session % 5 = 0 and turn = 1) as has_audio, case when session % 5 = 0 and turn = 1 then 'asked to' end as deleted from obs""")
def observation_cards(spark, sf_dir):
    """Every observation as callers see it; a fifth of the sessions had a turn deleted."""
    obs = observations(spark, sf_dir).withColumn("blob", F.when(F.expr("turn % 3 != 0"), F.sha2("text", 256)))
    return S.shaped_observations(obs, obs.where("session % 5 = 0 and turn = 1").select("id", F.lit("asked to").alias("reason")))


_KEYS = {"outward": ("off", "on"), "approval": ("on", "off"), "relevance": ("required", "advisory", "off"), "wake word": ("Thea", "Mira"), "voice": ("plain",), "never set": ("default",)}
_LOG = "log as (select case event_type when 'click' then 'outward' when 'view' then 'approval' when 'error' then 'relevance' when 'signup' then 'wake word' else 'voice' end as key, ['off', 'on', 'advisory', 'Mira', 'loud'][cast(event_id % 5 + 1 as integer)] as value, ts, event_id from events)"


@query(f"""with {_LOG}, last as (select key, max_by(value, (ts, value)) as value from log group by key), d(key, allowed) as (values {", ".join(f"('{k}', {_list(v)})" for k, v in _KEYS.items())})
select d.key, case when list_contains(allowed, value) then value else allowed[1] end as value from d left join last using (key)""")
def settings_in_force(spark, sf_dir):
    key = F.expr("case event_type when 'click' then 'outward' when 'view' then 'approval' when 'error' then 'relevance' when 'signup' then 'wake word' else 'voice' end")
    log = table(spark, sf_dir, "events").select(key.alias("key"), F.expr("element_at(array('off', 'on', 'advisory', 'Mira', 'loud'), cast(event_id % 5 as int) + 1)").alias("value"), F.col("ts").alias("at"))
    return S.latest_settings(log, _KEYS)


@query("""with last as (select user_id as caller, event_type as tool, max_by(event_id, (ts, event_id)) as id from events where event_id % 3 <> 1 group by 1, 2), now as (select max(epoch(ts)) - 86400 as now from events)
select caller, tool, round(epoch(ts) + 60 * (event_id % 5000), 3) as expires_at from last join events on event_id = id, now where event_id % 3 = 0 and epoch(ts) + 60 * (event_id % 5000) > now""")
def standing_grants(spark, sf_dir):
    """Grants that still hold a day before the table's end; the last grant or revocation of a caller for a tool decides."""
    e = table(spark, sf_dir, "events").selectExpr("user_id as caller", "event_type as tool", "if(event_id % 3 = 0, 'grant', 'revoke') as action", f"{epoch('ts')} as at", "event_id % 5000 as minutes", "event_id")
    now = e.agg(F.max("at")).first()[0] - 86400
    return S.standing(e.where("event_id % 3 != 1"), F.lit(now)).withColumn("expires_at", F.round("expires_at", 3))


@query("""with a as (select event_id as id, user_id * 11 as caller, case when event_id % 4 = 0 then '' when event_id % 4 = 1 then 'guess' else 'secret-' || (user_id * 11) end as secret from events),
c as (select c_custkey as caller, case when c_mktsegment = 'BUILDING' then null else sha256('salt' || c_custkey || 'secret-' || c_custkey) end as hash from customer)
select id, case when c.caller is null then 'unknown' when hash is null then 'no secret set' when secret = '' then 'none presented' when sha256('salt' || c.caller || secret) <> hash then 'wrong' else 'ok' end as outcome from a left join c on c.caller = a.caller""")
def authentications(spark, sf_dir):
    attempts = table(spark, sf_dir, "events").selectExpr("event_id as id", "user_id * 11 as caller", "case event_id % 4 when 0 then '' when 1 then 'guess' else concat('secret-', user_id * 11) end as secret")
    own = F.concat(F.lit("secret-"), F.col("c_custkey").cast("string"))
    salt = F.concat(F.lit("salt"), F.col("c_custkey").cast("string"))
    callers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("caller"), salt.alias("salt"), F.when(F.col("c_mktsegment") != "BUILDING", G.secret_hash(salt, own)).alias("hash"))
    return G.authenticated(attempts, callers)


@query("select c_custkey as caller, c_mktsegment <> 'BUILDING' as can_read, c_acctbal > 5000 as can_write, c_mktsegment <> 'BUILDING' as has_secret from customer")
def caller_listing(spark, sf_dir):
    """Callers without anything of their secrets."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey as caller", "c_mktsegment != 'BUILDING' as can_read", "c_acctbal > 5000 as can_write", "if(c_mktsegment != 'BUILDING', sha2(c_name, 256), null) as hash", "'salt' as salt")
    return G.listed(c)


@query("""with e as (select event_id, event_type as provider, cast(ts as date) as day, value * 100 as tokens, event_id % 97 = 0 as out, ts from events)
select event_id, count(*) over w as calls, round(sum(tokens) over w, 4) as tokens, bool_or(out) over w as halted from e window w as (partition by provider, day order by ts, event_id rows unbounded preceding)""")
def spend_ledger(spark, sf_dir):
    """What each call finds spent on its provider that day, and whether credit has run out, which stays so for the day."""
    calls = table(spark, sf_dir, "events").selectExpr("event_id as id", "event_type as provider", "to_date(ts) as day", "value * 100 as tokens", "event_id % 97 = 0 as out", "ts as at")
    return G.ledger(calls).select(F.col("id").alias("event_id"), "calls", F.round("tokens", 4).alias("tokens"), "halted")


@query("""with s as (select user_id, event_type as state, row_number() over (partition by user_id order by ts desc, event_id desc) as k, strftime(ts, '%Y-%m-%d %H:%M') as since from events)
select user_id, case state when 'error' then 'Paused since ' || since || '.' when 'signup' then 'Off the record since ' || since || '.' else 'Listening.' end as banner from s where k = 1""")
def capture_banners(spark, sf_dir):
    """The status sentence of each user after its last transition; an error pauses, a signup goes off the record."""
    e = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "ts as at", "case event_type when 'error' then 'paused' when 'signup' then 'incognito' else 'capturing' end as state")
    return G.banners(e, "user_id")


@query("""with a as (select p_partkey as path, sha256(p_name || p_brand) as digest from part where p_partkey % 7 <> 0), b as (select p_partkey as path, sha256(p_name || case when p_partkey % 5 = 0 then 'x' else p_brand end) as digest from part where p_partkey % 11 <> 0)
select path, case when b.path is null then 'deleted' when a.path is null then 'added' else 'edited' end as change from a full join b using (path) where a.digest is distinct from b.digest""")
def changed_modules(spark, sf_dir):
    """Files by digest then and now: what was edited, deleted or added."""
    p = table(spark, sf_dir, "part")
    then = p.where("p_partkey % 7 != 0").selectExpr("p_partkey as path", "concat(p_name, p_brand) as content")
    now = p.where("p_partkey % 11 != 0").selectExpr("p_partkey as path", "concat(p_name, if(p_partkey % 5 = 0, 'x', p_brand)) as content")
    return G.changed(G.snapshot(then), G.snapshot(now))


@query("select user_id as pid, round(max(epoch(ts)), 3) as last_seen from events group by 1 having (select max(epoch(ts)) from events) - max(epoch(ts)) <= 900 * 20 and max_by(event_type, (ts, event_id)) <> 'error'")
def reaped_processes(spark, sf_dir):
    """Processes that stay: not ended, and heard within 900 s, here of twenty-fold time."""
    e = table(spark, sf_dir, "events").selectExpr("user_id as pid", f"{epoch('ts')} / 20 as at", "event_id", "event_type = 'error' as ended")
    return G.reaped(e, e.agg(F.max("at")).first()[0]).select("pid", F.round(F.col("last_seen") * 20, 3).alias("last_seen"))


@query("""with e as (select doc_id, '{"doc_id":' || doc_id || ',"source":"' || source || '","n_chars":' || n_chars || ',"text":"' || replace(text, chr(10), ' ') || '"}' as body from documents)
select doc_id, strlen(body) as bytes, strlen(body) > 4096 as stub, md5(case when strlen(body) > 4096 then '{"doc_id":' || doc_id || ',"oversize":' || strlen(body) || '}' else body end) as sent from e""")
def published_events(spark, sf_dir):
    """Events as they go out; what is too long for a datagram is replaced by a stub."""
    d = table(spark, sf_dir, "documents")
    body = F.concat(F.lit('{"doc_id":'), "doc_id", F.lit(',"source":"'), "source", F.lit('","n_chars":'), "n_chars", F.lit(',"text":"'), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit('"}'))
    out = A.published(d.select("doc_id", body.alias("body")), 4096)
    return out.select("doc_id", "bytes", "stub", F.md5("sent").alias("sent"))


@query("select event_id, event_type, user_id from events order by ts desc, event_id desc limit 200")
def recent_events(spark, sf_dir):
    """The newest 200 events, newest first: a report of that length."""
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "event_type", "user_id")


@query("select count(*) as blobs, cast(sum(bytes) as bigint) as bytes from (select distinct sha256(text) as digest, strlen(text) as bytes from documents)")
def archive_usage(spark, sf_dir):
    """Documents put into a new archive, each text once: what its files hold."""
    return A.usage(spark, _archived(spark, sf_dir))


def _archived(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.col("text").cast("binary").alias("content"))
    folder = f"{S.shared_folder(spark)}/archive-{S.uuid.uuid4().hex}"
    A.append(d, folder)
    return folder


@query("select doc_id, sha256(text) as digest, strlen(text) as bytes, true as intact from documents")
def archive_reads(spark, sf_dir):
    """Every document's blob by its digest, checked against it."""
    wanted = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return A.fetched(spark, _archived(spark, sf_dir), wanted).select("doc_id", "digest", F.octet_length("content").cast("long").alias("bytes"), "intact")


@query("select vec_id, round(list_sum(list_transform(embedding[cast(label * 4 + 1 as integer) : cast(label * 4 + 8 as integer)], lambda x: cast(x as double))), 6) as total, len(embedding[cast(label * 4 + 1 as integer) : cast(label * 4 + 8 as integer)]) as n from embeddings")
def located_samples(spark, sf_dir):
    """Of each run's samples those of one utterance, by offset and length."""
    v = table(spark, sf_dir, "embeddings")
    rows = v.select("vec_id", A.located(F.col("embedding"), F.col("label") * 4, F.lit(8)).alias("s"))
    return rows.select("vec_id", F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"), F.size("s").cast("long").alias("n"))


@query("""with f as (select doc_id, strlen(text) as n, unnest(generate_series(0, greatest((strlen(text) + 511) // 512, 1) - 1)) as frame from documents)
select doc_id, frame, least(512, n - 512 * frame) as bytes from f where frame * 512 / 16000.0 < 0.5""")
def bounded_frames(spark, sf_dir):
    """Texts as recordings of a byte a sample, cut into frames of 512, up to half a second: the bound is what is asked for."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.octet_length("text").cast("long").alias("n"))
    return A.bounded(A.framed(d, F.col("n")), 0.5).select("doc_id", "frame", "bytes")


_PRINTS = "p as (select label as person, vec_id, embedding, row_number() over (partition by label order by vec_id) - 1 as k from embeddings)"


@query(f"with {_PRINTS} select 'p' || person as pid, case when k = 0 then 'anchor' else 'learned' end as kind, cast(case when k = 0 then 0 else k - 1 end as integer) as at, round(cast(embedding[1] as double), 6) as first from p")
def people_vectors(spark, sf_dir):
    """Everyone's prints, the anchor first, from a JSON file that was saved and loaded again under the same setup."""
    path = f"{S.shared_folder(spark)}/people-{S.uuid.uuid4().hex}"
    P.save(_people(spark, sf_dir), path, {"model": "own", "size": "64"})
    return P.vectors(P.load(spark, path, {"size": "64", "model": "own"})).select("pid", "kind", "at", F.round(F.col("vector")[0], 6).alias("first"))


def _people(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    prints = v.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    vectors = F.transform("v", lambda x: x["embedding"].cast("array<double>"))
    return prints.select(F.concat(F.lit("p"), F.col("label").cast("string")).alias("pid"), F.concat(F.lit("Person "), F.col("label").cast("string")).alias("name"), F.slice(vectors, 1, 1).alias("anchor"), F.slice(vectors, 2, 1 << 30).alias("learned"))


@query("with w as (select user_id, case user_id % 3 when 0 then 'PERSON ' || (user_id % 12) when 1 then 'P' || (user_id % 12) else 'nobody' end as said from (select distinct user_id from events)), p as (select distinct label from embeddings) select user_id, case when label is null then '' else 'p' || label end as pid from w left join p on lower(said) in (lower('Person ' || label), lower('p' || label))")
def people_found(spark, sf_dir):
    """People asked for by name or id, letter case aside."""
    asked = table(spark, sf_dir, "events").select("user_id").distinct().selectExpr("user_id", "case user_id % 3 when 0 then concat('PERSON ', user_id % 12) when 1 then concat('P', user_id % 12) else 'nobody' end as said")
    return P.found(asked, _people(spark, sf_dir)).select("user_id", F.coalesce("pid", F.lit("")).alias("pid"))
