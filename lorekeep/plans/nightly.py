"""Consolidation, answers and what they rest on, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import nightly as N
from ..operators import store
from ..operators import timeline as T
from ..operators.guards import MIN_CLAUSE, MIN_OVERLAP
from ..sources.views import OBSERVATIONS, observations, table
from .catalog import query
from .text import _CONTENT, _DATES, _OVERLAP

_NORMAL = lambda t: f"trim(regexp_replace(trim(lower({t})), '\\s+', ' ', 'g'), ' .,!?;:\"''')"
_EPISODES = f"""{OBSERVATIONS}, cut as (select *, coalesce(started_at - lag(ended_at) over (partition by session order by started_at, id) > 8, true)::int as fresh from obs),
part as (select *, sum(fresh) over (partition by session order by started_at, id) as part from cut),
ep as (select cast(session * 100 + part as bigint) as id, session, part, session // 20 as day, count(*) as n, cast(sum(len(regexp_extract_all(text, '\\S+'))) as bigint) as words, avg(case when person = 'user' then 1.0 else 0.0 end) > 0.5 as recognised, min(started_at) as "at",
  list(text order by started_at, id) as lines, list(id order by started_at, id) as sources, coalesce(max_by(text, (started_at, id)) filter (kind = 'answer'), '') as last_answer from part group by session, part),
said as (select *, session % 11 <> 0 as worth, case when session % 7 = 1 then '' when session % 7 = 2 then 'Nobody ever mentioned purple zeppelins over Samarkand' when session % 7 = 3 then last_answer else lines[1] end as statement,
  case when session % 13 = 0 then ' ' else 'Topic ' || (session % 5) || case session % 3 when 0 then ', other' when 1 then ' and more' else '' end end as topic,
  case when session % 7 = 4 then 'purple zeppelins over Samarkand, I am told' else string_split(lines[1], '. ')[-1] end as support from ep),
c as (select *, trim(regexp_split_to_array(lower(trim(topic)), '[,;/]| and ')[1]) as about, round(greatest(least(0.45 + 0.05 * least(n - 1, 6) + case when recognised then 0.10 else 0.0 end, 0.75), 0.35), 3)::double as certainty,
  len(list_filter(lines, lambda x: {_NORMAL('support')} <> '' and {_NORMAL('x')} <> '' and (contains({_NORMAL('x')}, {_NORMAL('support')}) or contains({_NORMAL('support')}, {_NORMAL('x')})))) > 0 as grounded,
  {_OVERLAP('statement', "array_to_string(lines, chr(10))")} as overlap from said),
r as (select *, case when words < 25 then 'only ' || words || ' words' when not worth then 'nothing worth concluding' when trim(statement) = '' then 'said worth but wrote nothing' when about = '' then 'no subject' when not grounded then 'not grounded' when overlap < 0.25 then 'words never said' else 'ok' end as reason from c)"""


def _episodes(spark, sf_dir):
    """Runs of a session's turns without a silence of more than eight seconds, of twenty sessions to a day, with what a judge would propose: the first line's own words, or in some sessions nothing, an answer, or what was never said."""
    obs = observations(spark, sf_dir).withColumn("w", T.word_count("text").cast("long"))
    order = "partition by session order by started_at, id"
    parts = obs.selectExpr("*", f"int(coalesce(started_at - lag(ended_at) over ({order}) > 8, true)) as fresh").selectExpr("*", f"sum(fresh) over ({order}) as part")
    rows = F.array_sort(F.collect_list(F.struct("started_at", "id", "kind", "text")))
    e = parts.groupBy("session", "part").agg(F.count("*").alias("n"), F.sum("w").alias("words"), (F.avg((F.col("person") == "user").cast("double")) > 0.5).alias("recognised"), F.min("started_at").alias("at"), rows.alias("rows"))
    e = e.selectExpr("session * 100 + part as id", "session", "session div 20 as day", "n", "words", "recognised", "at", "transform(rows, x -> x.text) as lines", "transform(rows, x -> x.id) as sources", "coalesce(get(reverse(filter(rows, x -> x.kind = 'answer')), 0).text, '') as last_answer")
    return e.selectExpr(
        "*", "session % 11 != 0 as worth",
        "case when session % 7 = 1 then '' when session % 7 = 2 then 'Nobody ever mentioned purple zeppelins over Samarkand' when session % 7 = 3 then last_answer else lines[0] end as statement",
        "case when session % 13 = 0 then ' ' else concat('Topic ', session % 5, case session % 3 when 0 then ', other' when 1 then ' and more' else '' end) end as about",
        "case when session % 7 = 4 then 'purple zeppelins over Samarkand, I am told' else element_at(split(lines[0], '[.] '), -1) end as support",
    )


def _considered(spark, sf_dir):
    return N.considered(_episodes(spark, sf_dir)).withColumn("certainty", N.certainty(F.col("n"), F.col("recognised")))


@query(f"with {_EPISODES} select id, day, n, words, certainty, reason from r")
def episodes_considered(spark, sf_dir):
    """Every episode: how certain a belief from it would be, and why there is none."""
    return _considered(spark, sf_dir).select("id", "day", "n", "words", "certainty", "reason")


@query(f"with {_EPISODES} select id, about, day, certainty, round(overlap, 6) as overlap, statement from r where reason = 'ok'")
def beliefs_of_days(spark, sf_dir):
    """What the days' episodes conclude, with the share of its words that were said."""
    return _considered(spark, sf_dir).where("reason = 'ok'").select("id", "about", "day", "certainty", F.round("overlap", 6).alias("overlap"), "statement")


@query(f"with {_EPISODES} select day, count(*) filter (reason = 'ok') as written, count(*) filter (reason <> 'ok') as rejected from r group by day")
def nightly_report(spark, sf_dir):
    ok = (F.col("reason") == "ok").cast("long")
    return _considered(spark, sf_dir).groupBy("day").agg(F.sum(ok).alias("written"), F.sum(1 - ok).alias("rejected"))


@query(None)
def nights_consolidated(spark, sf_dir):
    """All days consolidated into a store, the last five by the nightly run and those before by hand, and the nightly run again, which writes nothing: what the store then holds, and what the runs counted."""
    s = store.Store(spark)
    e = store.with_checkpoints(spark) and _episodes(spark, sf_dir).withColumn("day", F.least(F.col("day"), F.lit(7))).checkpoint()
    days = [r["day"] for r in e.select("day").distinct().orderBy("day").collect()]  # eight at most
    runs = [("by hand", N.run_day(s, e, day)) for day in days[:-5] or days[:1]]
    today = days[-1] + 1 if days else 1
    for step in ("night", "again"):
        runs += [(step, r) for r in N.nightly(s, e, today)["runs"]]
    edge = s.read("edges")
    replaces = edge.where("type = 'replaces'").select(F.col("src").cast("long").alias("id"), F.col("dst").cast("long").alias("replaces"))
    sources = edge.where("type = 'came-from'").groupBy(F.col("src").cast("long").alias("id")).agg(F.count("*").alias("sources"))
    held = s.read("beliefs").join(replaces, "id", "left").join(sources, "id", "left").select(F.lit("belief").alias("what"), "id", "about", "certainty", "replaces", "sources")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    marks = s.read("meta").select(F.lit("marker").alias("what"), F.col("value").cast("long").alias("id"), none("string", "about"), none("double", "certainty"), none("long", "replaces"), none("long", "sources"))
    told = spark.createDataFrame([(step, r["day"], None, None, r["written"], r["rejected"]) for step, r in runs], "what string, id long, about string, certainty double, replaces long, sources long")
    return held.union(marks).union(told)


@query(f"""with {OBSERVATIONS}, a as (select id, kind, text as answer, lag(text) over o as line, lag(id) over o as line_id from obs window o as (partition by session order by started_at, id)),
p as (select id, answer, coalesce(line, '') as line, line_id from a where kind <> 'system' union all select id || '+', string_split(line, '. ')[1], line, line_id from a where line is not null
  union all select id || '&', line || '. ' || string_split(answer, '. ')[1], line, line_id from a where line is not null union all select id || '@', line || ' in March 2031', line, line_id from a where line is not null),
w as (select p.id, min({_OVERLAP('part', 'line')}) as weakest from (select id, line, unnest(regexp_split_to_array(answer, '{fixed.CLAUSES}')) as part from p) p where len({_CONTENT('part')}) >= 2 group by p.id),
v as (select p.id, line_id, case when line = '' then 'nothing heard' when {_OVERLAP('answer', 'line')} < {MIN_OVERLAP} then 'overlap' when weakest < {MIN_CLAUSE} then 'clause' when len(list_filter({_DATES('answer')}, lambda x: not list_contains({_DATES('line')}, x))) > 0 then 'date' else 'ok' end as verdict from p left join w using (id))
select id, verdict, case when verdict = 'ok' then line_id end as source from v""")
def answers_tried(spark, sf_dir):
    """Every whole turn as an answer from the line before it, and as others that line's first sentence, that line with the turn's first sentence bolted on, and that line with a date: the guards' verdicts, and the source of those that pass."""
    order = "partition by session order by started_at, id"
    a = observations(spark, sf_dir).selectExpr("id", "kind", "text as answer", f"lag(text) over ({order}) as line", f"lag(id) over ({order}) as line_id")
    own = a.where("kind != 'system'").selectExpr("id", "answer", "coalesce(line, '') as line", "line_id")
    made = {"+": "split(line, '[.] ')[0]", "&": "concat(line, '. ', split(answer, '[.] ')[0])", "@": "concat(line, ' in March 2031')"}
    for sign, answer in made.items():
        own = own.union(a.where("line is not null").selectExpr(f"concat(id, '{sign}') as id", f"{answer} as answer", "line", "line_id"))
    return N.answered(own)


@query("select doc_id, md5(array_to_string(list_filter([trim(coalesce(lang, '')), trim(coalesce(source, '')), trim(coalesce(text, ''))], lambda x: x <> ''), chr(10))) as leaves from documents")
def outward_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(N.outward(["text", "lang", "source"])).alias("leaves"))


@query("""with n as (select event_id, [event_id % 9, user_id % 9, event_id % 5, 1, event_id % 9] as nums, user_id % 7 as k from events)
select event_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(nums, lambda x: x - 1), lambda x: x >= 0 and x < k))), ',') as kept from n""")
def judged_batches(spark, sf_dir):
    """A judge's replies in bulk, made into places of candidates."""
    e = table(spark, sf_dir, "events")
    nums = F.expr("array(event_id % 9, user_id % 9, event_id % 5, 1L, event_id % 9)")
    return e.select("event_id", F.array_join(N.judged(nums, F.col("user_id") % 7).cast("array<string>"), ",").alias("kept"))


@query("""with last as (select user_id, max(epoch(ts)) as seen, max_by(event_type, (ts, event_type = 'error')) <> 'error' as ok from events group by user_id), now as (select max(epoch(ts)) as now from events)
select user_id, case when now - seen > 60 * 300 then 'probe' when ok then 'available' else 'down' end as health from last, now""")
def judges_available(spark, sf_dir):
    """The health of each user's judge from its last outcome, fresh for 60 s, here of three-hundred-fold time."""
    e = table(spark, sf_dir, "events").selectExpr("user_id", "(datediff(to_date(ts), date'1970-01-01') * 86400.0D + hour(ts) * 3600 + minute(ts) * 60 + extract(second from ts)) / 300 as at", "event_type != 'error' as ok")
    return N.available(e, "user_id", F.lit(e.agg(F.max("at")).first()[0]))


_DETAILS = "['Your credit balance is too low', 'Rate limit reached, slow down', 'PREPAYMENT credits are depleted', 'quota', 'Quota exceeded for today', 'cannot generate or operate now', 'see plan and billing', 'the bridge closed', 'Bad JSON', '']"


@query(f"""with {OBSERVATIONS}, m as (select id, text || ' ' || {_DETAILS}[cast((session + turn) % 10 + 1 as integer)] as m, turn % 5 = 4 as gone, case when turn % 4 = 1 then session % 2 = 0 end as ok from obs)
select id, case when {" or ".join(f"contains(lower(m), '{w}')" for w in fixed.OUT_OF_CREDIT)} then 'out of credit' else 'rate limited' end as refused, gone or {" or ".join(f"contains(lower(m), '{w}')" for w in fixed.INFRASTRUCTURE)} or coalesce(not ok, false) as broke from m""")
def failures_classified(spark, sf_dir):
    """Every turn followed by a detail, read as why a call was refused and as a judge's error."""
    rows = observations(spark, sf_dir).selectExpr("id", f"concat(text, ' ', element_at(array({_DETAILS[1:-1]}), cast((session + turn) % 10 as int) + 1)) as m", "turn % 5 = 4 as gone", "if(turn % 4 = 1, session % 2 = 0, null) as ok")
    return rows.select("id", N.refused(F.col("m")).alias("refused"), N.broke(F.col("gone"), F.col("m"), F.col("ok")).alias("broke"))


@query(f"""with {OBSERVATIONS}, t as (select id, turn, case turn % 4 when 1 then regexp_replace(text, '[.!?]+$', ',') when 2 then regexp_replace(text, '[.!?]+$', '') when 3 then regexp_replace(text, '[.!?]+$', '…') else text end as t from obs)
select id, case when turn % 3 = 0 and not t like '%?' then regexp_replace(t, '[.,…]$', '') || '?' when not (regexp_matches(t, '[.!?…]$') or turn % 3 = 1) then regexp_replace(t, ',$', '') || '—' else t end as line from t""")
def terminal_signs(spark, sf_dir):
    """Every turn, with its last mark made a comma, none or an ellipsis in three of four, with the sign that its sound asks for; a third rise, another third fall."""
    rows = observations(spark, sf_dir).selectExpr("id", "turn", "case turn % 4 when 1 then regexp_replace(text, '[.!?]+$', ',') when 2 then regexp_replace(text, '[.!?]+$', '') when 3 then regexp_replace(text, '[.!?]+$', '…') else text end as t")
    t = F.col("t")
    return rows.select("id", N.terminal(t, F.expr("turn % 3 = 0"), t.endswith("?"), t.rlike("[.!?…]$"), F.expr("turn % 3 = 1")).alias("line"))


@query("select conv_id, 'D' || conv_id || ':' || turn as id, row_number() over (partition by conv_id order by turn) - 1 as place, role as speaker, text from conversations")
def loaded_conversations(spark, sf_dir):
    """Conversations written as nested JSON and loaded again: a turn is an observation, in its conversation's order."""
    path = f"{store.shared_folder(spark)}/conversations-{uuid.uuid4().hex}"
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.concat(F.lit("D"), "conv_id", F.lit(":"), "turn").alias("dia_id"), F.col("role").alias("speaker"), "text").alias("t"))
    turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("conversation")).write.json(path)
    back = spark.read.schema("conv_id long, conversation array<struct<turn: long, dia_id: string, speaker: string, text: string>>").json(path)
    return back.select("conv_id", F.posexplode("conversation").alias("place", "t")).select("conv_id", F.col("t.dia_id").alias("id"), F.col("place").cast("long").alias("place"), "t.speaker", "t.text")


@query("""with k as (select conv_id, unnest(['session_10', 'session_2', 'session_1']) as key from (select distinct conv_id from conversations))
select conv_id, key, row_number() over (partition by conv_id order by cast(regexp_extract(key, '[0-9]+$') as integer)) - 1 as place from k""")
def sessions_in_order(spark, sf_dir):
    """The sessions of a conversation by their number, not by the text of their key."""
    keys = F.array(F.lit("session_10"), F.lit("session_2"), F.lit("session_1"))
    by_number = F.array_sort(F.transform(keys, lambda k: F.struct(F.regexp_extract(k, "[0-9]+$", 0).cast("int").alias("n"), k.alias("key"))))
    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return rows.select("conv_id", F.posexplode(by_number).alias("place", "s")).select("conv_id", F.col("s.key").alias("key"), F.col("place").cast("long").alias("place"))


@query("""with q as (select distinct conv_id as question from conversations), g as (select conv_id, string_agg(text, '|' order by 'D' || conv_id || ':' || turn) as gold, count(*) as n from conversations where turn in (1, 3) or turn = conv_id % 8 group by conv_id)
select question, md5(coalesce(gold, '')) as gold, coalesce(n, 0) as n from q left join g on conv_id = question""")
def gold_evidence(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    name = lambda t: F.concat(F.lit("D"), F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    asked = c.select("conv_id").distinct().select(F.col("conv_id").alias("question"), F.array(name(F.lit(1)), name(F.lit(3)), name(F.col("conv_id") % 8)).alias("evidence"))
    found = N.gold(asked, c.select(name(F.col("turn")).alias("id"), "text"))
    return found.select("question", F.md5(F.array_join("gold", "|")).alias("gold"), F.size("gold").cast("long").alias("n"))


@query("""with b as (select user_id, sha256('cue=' || event_type || chr(10) || 'size=64') as config, sha256(cast(count(*) as varchar)) as digest from events group by user_id, event_type),
now as (select user_id, config, digest, case when user_id % 5 = 0 then 'x' else config end as held, case when user_id % 7 = 0 then 'x' else digest end as content from b)
select user_id, config, case when held <> config then 'made under other settings' when content <> digest then 'content has changed' else 'ok' end as state from now""")
def baselines_checked(spark, sf_dir):
    """Baselines with the settings and content they were stamped with: which may be used."""
    from ..functions.ids import settings_digest
    from ..operators.governance import stamped

    b = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    config = settings_digest(F.create_map(F.lit("size"), F.lit("64"), F.lit("cue"), F.col("event_type")))
    now = b.select("user_id", config.alias("config"), F.sha2(F.col("n").cast("string"), 256).alias("digest"))
    held = now.withColumns({"held_config": F.when(F.expr("user_id % 5 = 0"), "x").otherwise(F.col("config")), "held_digest": F.when(F.expr("user_id % 7 = 0"), "x").otherwise(F.col("digest"))})
    return stamped(held).select("user_id", "config", "state")
