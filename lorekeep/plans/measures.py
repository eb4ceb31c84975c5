"""Baselines, z-scores, weights and marks of measured words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prosody as P
from ..sources.views import WORDS, words
from .catalog import query


@query(f"""with {WORDS} select speaker, count(loud) as n, round(sum(loud), 4) as s, round(avg(loud), 6) as mean, round(stddev_samp(loud), 6) as sd, count(pitch) as pitch_n, round(avg(pitch), 6) as pitch_mean
from words where not suspect group by speaker""")
def speaker_baseline_stats(spark, sf_dir):
    """By file (a day) first, then merged: what incremental baselines do."""
    good = words(spark, sf_dir).where("not suspect")
    per_file = good.groupBy("speaker", "sentence").agg(*P.sums(F.col("loud"), "l"), *P.sums(F.col("pitch"), "p"))
    t = per_file.groupBy("speaker").agg(*[F.sum(c).alias(c) for c in per_file.columns[2:]])
    mean, sd = P.mean_sd(F.col("l_n"), F.col("l_s"), F.col("l_q"))
    pm, _ = P.mean_sd(F.col("p_n"), F.col("p_s"), F.col("p_q"))
    return t.select("speaker", F.col("l_n").alias("n"), F.round("l_s", 4).alias("s"), F.round(mean, 6).alias("mean"), F.round(sd, 6).alias("sd"), F.col("p_n").alias("pitch_n"), F.round(pm, 6).alias("pitch_mean"))


@query(f"""with {WORDS}, g as (select *, count(*) over (partition by speaker, sentence) as n, row_number() over (partition by speaker, sentence order by "end", id) as k from words where not suspect and loud is not null),
x as (select speaker, sentence, n, (k - 1) / (n - 1) as x, loud as y from g where n >= 4),
s as (select speaker, sentence, regr_slope(y, x) as b, regr_intercept(y, x) as a from x group by speaker, sentence having regr_slope(y, x) <= 0),
m as (select speaker, count(*) as sentences, avg(b) as b, avg(a) as a from s group by speaker),
r as (select x.speaker, sum((y - m.a - m.b * x) ** 2) as q, count(*) as n from x join s on x.speaker = s.speaker and x.sentence = s.sentence join m on m.speaker = x.speaker group by x.speaker)
select m.speaker, sentences, round(b, 6) as slope, round(a, 6) as intercept, round(sqrt(q / (n - 1)), 4) as resid_sd from m join r using (speaker)""")
def declination_fit(spark, sf_dir):
    return P.declination(words(spark, sf_dir), "loud")


@query(f"""with {WORDS}, f as (select id, speaker, suspect, dur, case when not suspect then dur end as x, "end" from words),
w as (select id, speaker, x, count(x) over o as st_n, avg(x) over o as m, stddev_samp(x) over o as sd from f window o as (partition by speaker order by "end" range between 86400 preceding and current row exclude current row))
select id, speaker, st_n, case when x is not null then round(m, 9) end as st_mean, round((x - m) / case when sd > 1e-9 then sd end, 6) as st_z from w""")
def rolling_z(spark, sf_dir):
    return P.rolling_z(words(spark, sf_dir), "dur", 86400.0)


@query(f"""with {WORDS}, o as (select *, count(*) over (partition by speaker, sentence) as n, row_number() over (partition by speaker, sentence order by "end", id) as k from words),
p as (select *, case when n > 1 then (k - 1) / (n - 1) else 0 end as pos from o),
c as (select speaker, case when pos >= 0.999 then 'final' when pos <= 0.001 then 'initial' else 'middle' end as place, dur - avg(dur) over (partition by speaker) as c from p where not suspect),
e as (select speaker, place, count(c) as n, avg(c) as o, coalesce(var_pop(c), 0) as v from c group by speaker, place)
select speaker, place, n, round(o, 6) as offset, round(sqrt(sum(v * n) over (partition by speaker) / (sum(n) over (partition by speaker) - 1)), 6) as resid_sd from e""")
def position_offsets(spark, sf_dir):
    return P.position_offsets(words(spark, sf_dir), "dur")


@query(f"""with {WORDS}, o as (select speaker, "end" - lag("end") over w as b, lead("end") over w - "end" as a from words window w as (partition by speaker, sentence order by "end", id)),
c as (select speaker, quantile_cont(b, 0.8) as cap from o where b > 0 group by speaker)
select o.speaker, round(any_value(cap), 6) as cap, round(avg(least(coalesce(b, 0), cap) + least(coalesce(a, 0), cap)), 4) as mean, round(stddev_samp(least(coalesce(b, 0), cap) + least(coalesce(a, 0), cap)), 4) as sd
from o join c using (speaker) group by o.speaker""")
def pause_cap(spark, sf_dir):
    return P.pause_reference(words(spark, sf_dir))


_Z = f"""with {WORDS}, r as (select speaker, avg(loud) as lm, stddev_samp(loud) as ls, avg(dur) as dm, stddev_samp(dur) as ds, avg(pitch) as pm, stddev_samp(pitch) as ps from words where not suspect group by speaker),
z as (select id, speaker, (loud - lm) / nullif(ls, 0) as l, (dur - dm) / nullif(ds, 0) as d, (pitch - pm) / nullif(ps, 0) as p from words join r using (speaker)),
e as (select id, l, d, p, (coalesce(l * 0.45, 0) + coalesce(d * 0.25, 0) + coalesce(p * 0.2, 0)) / nullif(case when l is null then 0 else 0.45 end + case when d is null then 0 else 0.25 end + case when p is null then 0 else 0.2 end, 0) as w from z)"""


@query(_Z + "select id, round(l, 6) as loud_z, round(d, 6) as dur_z, round(p, 6) as pitch_z, round(w, 6) as weight, case when round(w, 6) > 1.659 then 2 when round(w, 6) > 1.143 then 1 else 0 end as level from e")
def emphasis_weight(spark, sf_dir):
    return P.long_term_z(words(spark, sf_dir))


@query(_Z + "select case when round(w, 6) > 1.659 then 2 when round(w, 6) > 1.143 then 1 else 0 end as level, count(*) as n, round(avg(w), 4) as mean from e group by 1")
def mark_levels(spark, sf_dir):
    return P.long_term_z(words(spark, sf_dir)).groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 4).alias("mean"))


def _rungs() -> str:
    q = lambda p: f"round(case when {p / 2!r} * n >= 2 then quantile_cont(x, {1 - p / 2!r}) when m >= 2 and e > 0 then u + e * ln({0.15 / (p / 2)!r}) end, 6)"
    return ", ".join(f"{q(p)} as rung{k + 1}" for k, p in enumerate(P.GRADE_P))


@query(f"""with {WORDS}, u as (select speaker, count(value) as n, quantile_cont(value, 0.85) as u from words group by speaker),
o as (select w.speaker, count(*) as m, avg(value - u) as e from words w join u using (speaker) where value > u group by w.speaker),
j as (select speaker, n, u, m, e, value as x from words join u using (speaker) left join o using (speaker) where n >= 4)
select speaker, n, round(quantile_cont(x, 0.5), 6) as median, {_rungs()} from j group by speaker, n, u, m, e""")
def tail_quantiles(spark, sf_dir):
    return P.tail_quantiles(words(spark, sf_dir), "speaker", "value")


@query(f"""with {WORDS}, g as (select speaker, sentence, loud from words where not suspect), k as (select distinct speaker, sentence from g)
select k.speaker, k.sentence, round(median(g.loud), 6) as median from k left join g on k.speaker = g.speaker and k.sentence <> g.sentence group by k.speaker, k.sentence""")
def file_loudness_loo(spark, sf_dir):
    return P.leave_one_out_median(words(spark, sf_dir))


@query(f"""with {WORDS}, g as (select speaker, sentence, count(*) as n, count(case when not suspect then loud end) as usable, round(count(*) / nullif(max("end") - min("end"), 0), 6) as rate, round(avg(case when not suspect then loud end), 6) as loud,
  round(stddev_samp(case when not suspect then loud end), 6) as loud_sd, round(stddev_samp(case when not suspect then pitch end), 6) as pitch_sd from words group by speaker, sentence)
select * from g where n >= 3 and usable >= 3""")
def utterance_stats(spark, sf_dir):
    return P.utterance_stats(words(spark, sf_dir))


@query(f"""with {WORDS}, m as (select speaker, quantile_cont(loud, 0.5) as m from words group by speaker)
select id, array_to_string(list_filter([case when dur <= 0.0505 then 'zero_span' end, case when pitch is null then 'few_voiced' end, case when loud < m - 12 then 'quiet' end, case when dur > 0.8 and pitch > 300 then 'long_unvoiced' end], lambda x: x is not null), ',') as reasons
from words join m using (speaker)""")
def suspect_flags(spark, sf_dir):
    return P.suspect_reasons(words(spark, sf_dir))


@query(f"""with {WORDS}, u as (select speaker, sentence, min_by(pitch, ("end", id)) as a, max_by(pitch, ("end", id)) as z, count(*) as n from words where pitch is not null and not suspect group by speaker, sentence having count(*) >= 2)
select speaker, sentence, round(z - a, 4) as rise, z - a > 20 as question from u""")
def question_contour(spark, sf_dir):
    good = words(spark, sf_dir).where("pitch is not null and not suspect")
    u = good.groupBy("speaker", "sentence").agg(F.min_by("pitch", F.struct("end", "id")).alias("a"), F.max_by("pitch", F.struct("end", "id")).alias("z"), F.count("*").alias("n")).where("n >= 2")
    return u.select("speaker", "sentence", F.round(F.col("z") - F.col("a"), 4).alias("rise"), (F.col("z") - F.col("a") > 20).alias("question"))
