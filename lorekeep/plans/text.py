"""Grounding guards and answer scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import guards as G
from ..sources.views import OBSERVATIONS, observations, table
from .catalog import query

#: name, line, answer, support, question: cases of our own, for guards that the tables can't exercise.
CASES = [
    ("same", "The ferry to Arran left at nine on 4 March 2021.", "The ferry to Arran left at nine.", "the ferry to Arran left at nine", "When did the ferry leave?"),
    ("inflected", "Mira audited the harbour accounts in spring.", "The harbour accounts were audited by Mira.", "Mira audited the harbour accounts", "Who audited?"),
    ("other date", "We met Jonas on 4 March 2021 at the mill.", "Jonas was met at the mill in June 2020.", "We met Jonas", "When did we meet Jonas?"),
    ("other claim", "Petra repaired the old boiler.", "Petra repaired the old boiler and sold the bakery to strangers.", "Petra repaired the old boiler", "What did Petra repair?"),
    ("false clause", "Petra repaired the old boiler in the east cellar.", "Petra repaired the old boiler in the east cellar and sold bakeries.", "Petra repaired the old boiler", "What did Petra do?"),
    ("unrelated", "Tomatoes like warm nights.", "The train was late because of snow.", "the train was late", "Why was it late?"),
    ("invented name", "The choir sang two songs.", "The choir sang two songs for Bartholomew.", "The choir sang two songs", "Who sang?"),
    ("empty", "The choir sang two songs.", "", "", "Who sang?"),
    ("stopwords only", "It was there.", "It was not.", "it was", "Was it?"),
    ("punctuation", "Well, the key is under the blue pot!", "The key is under the blue pot", "  the key is   under the blue pot. ", "Where is the key?"),
    ("near miss", "The committee postponed the vote until autumn.", "The committee postponed the vote.", "The comittee postponed a vote until autum", "What was postponed?"),
]


def cases(spark, sf_dir):
    """The cases above and every turn as an answer: to the turn before it as a question, from the latter as the line that grounds it, with its own first 60 characters as support."""
    before = "coalesce(lag(text) over (partition by conv_id order by turn), '')"
    turns = table(spark, sf_dir, "conversations").selectExpr("concat('t', conv_id, '-', turn) as name", f"{before} as line", "coalesce(text, '') as answer", "substring(coalesce(text, ''), 1, 60) as support", f"{before} as question")
    return spark.createDataFrame(CASES, "name string, line string, answer string, support string, question string").unionByName(turns)


def _values() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    own = "select * from (values " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in CASES) + ") as own(name, line, answer, support, question)"
    before = "coalesce(lag(text) over (partition by conv_id order by turn), '')"
    return f"cases(name, line, answer, support, question) as materialized ({own} union all select 't' || conv_id || '-' || turn, {before}, coalesce(text, ''), substr(coalesce(text, ''), 1, 60), {before} from conversations)"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_STOP, _MONTHS = _list(fixed.STOPWORDS), _list(fixed.MONTHS)
_TOK = lambda t: f"regexp_extract_all(lower({t}), '[a-z0-9'']+')"
_CONTENT = lambda t: f"list_filter({_TOK(t)}, lambda w: len(w) > 1 and not list_contains({_STOP}, w))"
_STEMS = lambda t: f"list_transform({_TOK(t)}, lambda w: substr(w, 1, 5))"
_OVERLAP = lambda a, t: f"(select case when len(c) = 0 then 0.0 else len(list_filter(c, lambda w: list_contains(h, w) or list_contains(s, substr(w, 1, 5)))) / len(c) end from (select {_CONTENT(a)} as c, {_TOK(t)} as h, {_STEMS(t)} as s))"


@query(f"with {_values()} select name, round({_OVERLAP('answer', 'line')}, 6) as overlap from cases")
def answer_overlap(spark, sf_dir):
    return cases(spark, sf_dir).select("name", F.round(G.overlap(F.col("answer"), F.col("line")), 6).alias("overlap"))


@query(f"""with {_values()}, c as (select name, line, unnest(regexp_split_to_array(answer, '{fixed.CLAUSES}')) as part from cases)
select n.name, o.weakest from (select name from cases) n left join (select name, round(min({_OVERLAP('part', 'line')}), 6) as weakest from c where len({_CONTENT('part')}) >= 2 group by name) o using (name)""")
def weakest_clause(spark, sf_dir):
    return cases(spark, sf_dir).select("name", F.round(G.weakest_clause(F.col("answer"), F.col("line")), 6).alias("weakest"))


_DATES = lambda t: f"list_distinct(list_concat(list_filter(regexp_extract_all(lower({t}), '[a-z]+'), lambda w: list_contains({_MONTHS}, w)), regexp_extract_all(lower({t}), '\\b(?:19|20)[0-9]{{2}}\\b')))"


@query(f"with {_values()} select name, array_to_string(list_sort(list_filter({_DATES('answer')}, lambda w: not list_contains({_DATES('line')}, w))), ',') as borrowed from cases")
def date_guard(spark, sf_dir):
    return cases(spark, sf_dir).select("name", F.array_join(F.array_sort(G.borrowed_dates(F.col("answer"), F.col("line"))), ",").alias("borrowed"))


_ALLOWED = _list(dict.fromkeys([*fixed.FRAMING, *fixed.STOPWORDS]))


@query(f"""with {_values()}, t as (select name, list_filter({_TOK('answer')}, lambda w: len(w) > 1) as c, list_concat({_ALLOWED}, list_concat({_TOK('question')}, {_TOK('line')})) as h from cases),
u as (select name, c, h, list_transform(h, lambda w: substr(w, 1, 5)) as s from t)
select name, array_to_string(list_sort(list_distinct(list_filter(c, lambda w: not (list_contains(h, w) or list_contains(s, substr(w, 1, 5)))))), ',') as invented from u""")
def invented_words(spark, sf_dir):
    return cases(spark, sf_dir).select("name", F.array_join(F.array_sort(G.invented(F.col("answer"), F.col("question"), F.col("line"))), ",").alias("invented"))


@query("""with d as (select doc_id, trim(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g'), ' .,!?;:"''') as n from documents), b as (select item_id, trim(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g'), ' .,!?;:"''') as s from benchmark)
select item_id, count(*) as lines, min(doc_id) as first_line from b join d on s <> '' and contains(n, s) group by item_id""")
def grounded_contains(spark, sf_dir):
    """Which documents ground each benchmark text by containment; empty texts ground nothing."""
    b = table(spark, sf_dir, "benchmark").select("item_id", G.normal(F.col("text")).alias("s"))
    d = table(spark, sf_dir, "documents").select("doc_id", G.normal(F.col("text")).alias("n"))
    return G.containing(d, b).groupBy("item_id").agg(F.count("*").alias("lines"), F.min("doc_id").alias("first_line"))


@query(None)
def guard_verdicts(spark, sf_dir):
    """All guards on the cases, the likest line found by similarity where none contains the support."""
    c = cases(spark, sf_dir)
    lines = c.select("name", "support", "line", F.lit(0).alias("at"))
    held = G.grounded(lines).select("name", F.col("line").alias("held"))
    return c.join(held, "name").select("name", G.verdict(F.col("answer"), F.col("held")).alias("verdict"))


def _bag(t: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower({t}), '[^\\w\\s]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+'), lambda w: w <> '')"


@query(f"""with {_values()}, t as (select name, {_bag('answer')} as p, {_bag('line')} as g from cases),
c as (select name, len(p) as np, len(g) as ng, coalesce(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))), 0) as k from t)
select name, case when k = 0 then 0.0 else round(2.0 * k / (np + ng), 6) end as f1, np = ng and k = np as exact from c""")
def squad_f1(spark, sf_dir):
    k, p, g = G.f1(F.col("answer"), F.col("line"))
    rows = cases(spark, sf_dir).select("name", k.alias("k"), p.alias("p"), g.alias("g"))
    return rows.select("name", F.when(F.col("k") == 0, 0.0).otherwise(F.round(2.0 * F.col("k") / (F.col("p") + F.col("g")), 6)).alias("f1"), ((F.col("p") == F.col("g")) & (F.col("k") == F.col("p"))).alias("exact"))


@query(f"""with {_values()}, grid as (select unnest([0.6, 0.5, 0.4, 0.3, 0.2]) as least), o as (select name, {_OVERLAP('answer', 'line')} as v, name in ('same', 'inflected', 'punctuation', 'near miss') as good from cases)
select round(least, 2) as least, count(*) filter (v >= least) as emitted, count(*) filter (v >= least and good) as correct from grid, o group by least""")
def threshold_grid(spark, sf_dir):
    """How many answers pass at each threshold, and how many of them should: one pass over the replies, the thresholds beside each."""
    rows = cases(spark, sf_dir).select(G.overlap(F.col("answer"), F.col("line")).alias("v"), F.col("name").isin("same", "inflected", "punctuation", "near miss").alias("good"))
    rows = rows.select("v", "good", F.explode(F.array(*[F.lit(x) for x in (0.6, 0.5, 0.4, 0.3, 0.2)])).alias("least"))
    return rows.groupBy("least").agg(F.sum((F.col("v") >= F.col("least")).cast("long")).alias("emitted"), F.sum(((F.col("v") >= F.col("least")) & F.col("good")).cast("long")).alias("correct"))


@query(f"with {OBSERVATIONS} select kind, count(*) as n, cast(sum(case when regexp_matches(text, '\\?\\s*$') then 1 else 0 end) as bigint) as questions, cast(sum(len(regexp_extract_all(text, '\\S+'))) as bigint) as words from obs group by kind")
def question_flags(spark, sf_dir):
    from ..operators.timeline import word_count

    rows = observations(spark, sf_dir).select("kind", F.col("text").rlike(r"\?\s*$").cast("long").alias("q"), word_count("text").cast("long").alias("w"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("q").alias("questions"), F.sum("w").alias("words"))


@query(f"with {OBSERVATIONS} select id, '[' || strftime(make_timestamp(cast(started_at as bigint) * 1000000), '%d %B %Y') || '] ' || person || ': ' || text as line from obs")
def format_lines(spark, sf_dir):
    when = F.date_format(F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(started_at as decimal(18, 6)))"), "dd MMMM yyyy")
    return observations(spark, sf_dir).select("id", F.concat(F.lit("["), when, F.lit("] "), "person", F.lit(": "), "text").alias("line"))


@query(f"select conv_id, turn, coalesce(ends_with(lower(trim(text)), '?') or list_contains({_list(fixed.QUESTION_WORDS)}, regexp_extract(lower(trim(text)), '^\\S*')), false) as asks from conversations")
def question_shaped(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", G.question_shaped(F.col("text")).alias("asks"))


@query(None)
def one_line(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", G.one_line(F.col("text")).alias("line"))


@query(None)
def wake_calls(spark, sf_dir):
    """Turns in which a name calls, and what is left without it."""
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id * 100 + turn as id", "text")
    return G.called(rows, "Thea")
