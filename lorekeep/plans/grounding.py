"""Quotes held against all lines: which support them, and which answers from them pass the guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import guards as G
from ..operators import nightly as N
from ..operators import similar as X
from ..operators.guards import MIN_CLAUSE, MIN_OVERLAP
from ..sources.views import OBSERVATIONS, observations
from .catalog import query
from .text import _CONTENT, _DATES, _OVERLAP, _STEMS, _TOK, _list

_PAIRS = f"""{OBSERVATIONS}, q as (select id as quote, string_split(text, '. ')[-1] as said, {_CONTENT("string_split(text, '. ')[-1]")} as c from obs), l as (select id as line, text, list_distinct({_STEMS('text')}) as s from obs),
p as (select quote, said, line, text, len(list_filter(c, lambda w: list_contains(s, substr(w, 1, 5)))) / len(c) as overlap from q, l where len(c) > 0 and quote <> line),
pairs as (select * from p where overlap >= 0.8)"""


def _quotes(spark, sf_dir):
    """The last sentence of every turn, and all turns as lines."""
    obs = observations(spark, sf_dir)
    return obs.select("id", F.element_at(F.split("text", "[.] "), -1).alias("text")), obs.select("id", "text")


def _supported(spark, sf_dir):
    quotes, lines = _quotes(spark, sf_dir)
    return X.supported(quotes, lines)


@query(f"with {_PAIRS} select quote, count(*) as n, arg_min(line, (-overlap, line)) as line, round(max(overlap), 6) as overlap from pairs group by quote")
def supports_found(spark, sf_dir):
    """The last sentence of every turn held against all other turns: how many have four fifths of its words, and the one that has most."""
    return _supported(spark, sf_dir).withColumn("overlap", F.round("overlap", 6))


@query(f"""with {_PAIRS}, b as (select quote as id, any_value(said) as answer, arg_min(line, (-overlap, line)) as line_id, arg_min(text, (-overlap, line)) as line from pairs group by quote),
w as (select b.id, min({_OVERLAP('part', 'line')}) as weakest from (select id, line, unnest(regexp_split_to_array(answer, '{fixed.CLAUSES}')) as part from b) b where len({_CONTENT('part')}) >= 2 group by b.id),
v as (select b.id, line_id, case when {_OVERLAP('answer', 'line')} < {MIN_OVERLAP} then 'overlap' when weakest < {MIN_CLAUSE} then 'clause' when len(list_filter({_DATES('answer')}, lambda x: not list_contains({_DATES('line')}, x))) > 0 then 'date' else 'ok' end as verdict from b left join w using (id))
select o.id, coalesce(verdict, 'nothing heard') as verdict, case when verdict = 'ok' then line_id end as source from obs o left join v using (id)""")
def answers_composed(spark, sf_dir):
    """The last sentence of every turn as an answer from the other turn that supports it best: the guards' verdict, and its source. Without any support nothing was heard."""
    quotes, lines = _quotes(spark, sf_dir)
    best = _supported(spark, sf_dir).select(F.col("quote").alias("id"), F.col("line").alias("line_id"))
    texts = best.join(lines.select(F.col("id").alias("line_id"), F.col("text").alias("line")), "line_id")  # one text for each quote that has any
    return N.answered(quotes.withColumnRenamed("text", "answer").join(texts, "id", "left"))


_LIST = lambda t: f"list_filter(regexp_split_to_array(trim({t}), '\\s+'), lambda w: w <> '')"


def _led(text: str, leads: tuple[str, ...]) -> str:
    for words in leads:
        text = f"regexp_replace({text}, '^{words}\\s+', '')"
    return text


_SAID = lambda form: f"replace(replace('{form.replace(chr(39), chr(39) * 2)}', '{{topic}}', topic), '{{fact}}', fact)"
_NAMED = "lower(trim(trim(named), '.\"'''))"
_PHRASE = f"array_to_string({_LIST(_NAMED)}, ' ')"


@query(f"""with {OBSERVATIONS}, o as (select id, turn, session, text, coalesce(lag(text) over (partition by session order by turn), '') as before from obs),
t as (select id, case turn % 4 when 0 then string_split(text, '. ')[-1] when 1 then 'The question of where is ' || string_split(text, ' ')[1] || ' located  place' when 2 then ' ' else ' "The topic."' end as named,
  case when session % 2 = 0 then 'What did ' else '' end || string_split(before, '. ')[-1] || '?' as question, session % 3 as retrieved, case when session % 3 = 1 then string_split(before, '. ')[1] else '' end as fact from o),
n as (select *, {_LIST(f"regexp_replace({_led(_PHRASE, fixed.TOPIC_LEADS)}, '\\s+{fixed.TOPIC_END}$', '')")} as own, {_LIST(_led("regexp_replace(lower(trim(question)), '[?.!]+$', '')", fixed.QUESTION_LEADS))} as asked from t),
c as (select *, array_to_string(case when len(own) between 1 and {fixed.TOPIC_WORDS} then own else asked[1:{fixed.SPARE_WORDS}] end, ' ') as topic from n)
select id, topic, case when len(topic) >= 2 and len(list_filter({_TOK('topic')}, lambda w: not list_contains({_list(fixed.EMPTY_WORDS)}, w))) > 0
  then case when fact <> '' then {_SAID(fixed.NOTHING_BUT)} when retrieved > 0 then {_SAID(fixed.NOTHING_IN)} else {_SAID(fixed.NOTHING_HERE)} end end as said from c""")
def refusals_composed(spark, sf_dir):
    """What is said where nothing answers: topics made of every turn, good, wordy, empty and without a subject, with the turn before as the question and its first sentence as the near fact."""
    o = observations(spark, sf_dir).selectExpr("id", "turn", "session", "text", "coalesce(lag(text) over (partition by session order by turn), '') as before")
    t = o.selectExpr(
        "id", """case turn % 4 when 0 then element_at(split(text, '[.] '), -1) when 1 then concat('The question of where is ', split(text, ' ')[0], ' located  place') when 2 then ' ' else ' "The topic."' end as named""",
        "concat(if(session % 2 = 0, 'What did ', ''), element_at(split(before, '[.] '), -1), '?') as question", "session % 3 as retrieved", "if(session % 3 = 1, split(before, '[.] ')[0], '') as fact",
    )
    t = t.withColumn("topic", G.clean_topic(F.col("named"), F.col("question")))
    return t.select("id", "topic", G.refusal(F.col("topic"), F.col("retrieved"), F.col("fact")).alias("said"))
