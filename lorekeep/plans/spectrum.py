"""Proxies of distance over all users' envelopes, and calibrations of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spectrum as X
from ..sources.views import WORDS, words
from .catalog import query

_FRAMES = f"""{WORDS}, frames as (select speaker, row_number() over (partition by speaker order by "end", id) - 1 as "at", round(loud, 2) as db from words),
start as (select speaker, list(db) as v, avg(db) as t from frames group by speaker),
halves as (select speaker, v, t, 0 as k, false as done from start union all
  select speaker, v, case when abs(m - t) < 1e-6 then t else m end, k + 1, abs(m - t) < 1e-6
  from (select *, (list_median(list_filter(v, lambda x: x > t)) + list_median(list_filter(v, lambda x: x <= t))) / 2 as m from halves where k < 50 and not done) where m is not null),
settled as (select speaker, arg_max(v, k) as v, arg_max(t, k) as t from halves group by speaker),
sides as (select speaker, v, list_median(list_filter(v, lambda x: x > t)) as hi, list_median(list_filter(v, lambda x: x <= t)) as lo from settled),
levels as (select speaker, case when hi is null or lo is null then list_median(v) else hi end as speech, case when hi is null or lo is null then list_median(v) else lo end as noise from sides),
lin as (select speaker, "at", pow(10, db / 20) as e, avg(pow(10, db / 20)) over s as mean, count(*) over s as n, max(db) over s > min(db) over s as moves from frames window s as (partition by speaker)),
x as (select speaker, n, "at", (e - mean) * (0.5 - 0.5 * cos(2 * pi() * "at" / (n - 1))) as x from lin where n > 2 and moves),
dft as (select speaker, n, j, sum(x * cos(2 * pi() * j * "at" / n)) as re, sum(x * sin(2 * pi() * j * "at" / n)) as im from x, (select unnest(generate_series(1, 100)) as j)
  where j <= n // 2 and j / (n * 0.01) >= 0.5 and j / (n * 0.01) < 16 group by all),
bands as (select speaker, sum(re * re + im * im) filter (j / (n * 0.01) >= 4) as fast, sum(re * re + im * im) filter (j / (n * 0.01) < 4) as slow from dft group by speaker),
voiced as (select speaker, quantile_cont(db, 0.9) - quantile_cont(db, 0.1) as dyn_range from frames join levels using (speaker) where db >= greatest(speech - 15, noise + 6) group by speaker),
proxies as (select s.speaker, len(v) as n, case when slow > 0 then 10 * log10(fast / slow) end as mod_ratio, dyn_range, speech as level
  from start s left join bands using (speaker) left join voiced using (speaker) left join levels using (speaker))"""


def _frames(spark, sf_dir):
    """Each user's events, in order, as frames of an envelope."""
    return words(spark, sf_dir).selectExpr("speaker", "row_number() over (partition by speaker order by end, id) - 1 as at", "round(loud, 2) as db")


@query(f"with recursive {_FRAMES} select speaker, n, round(mod_ratio, 6) as mod_ratio, round(dyn_range, 6) as dyn_range, round(level, 6) as level from proxies")
def distance_proxies(spark, sf_dir):
    """Both proxies and the level of speech of every user's whole series, which is taken as an envelope of 10 ms frames."""
    return X.distance_proxies(_frames(spark, sf_dir), "speaker").select("speaker", "n", *[F.round(c, 6).alias(c) for c in ("mod_ratio", "dyn_range", "level")])


_SETS = f"""{_FRAMES}, r as (select speaker // 7 as series, case when speaker % 7 < 3 then speaker % 7 end as distance, level, mod_ratio, dyn_range from proxies),
long as (select series, distance, level, 'mod_ratio' as proxy, mod_ratio as value from r union all select series, distance, level, 'dyn_range', dyn_range from r),
steps as (select *, value - lag(value) over (partition by series, proxy order by distance) as step from long where distance is not null),
far as (select series, proxy, count(*) as n, count(value) as measured, min(sign(step)) as down, max(sign(step)) as up, min(abs(step)) as least, max(abs(step)) as most,
  abs(arg_max(value, distance) - arg_min(value, distance)) as span, case when count(value) > 1 and max(value) > min(value) then regr_slope(level, value) end as slope from steps group by all),
same as (select series, proxy, count(*) as n_same, case when count(*) > 1 then max(value) - min(value) end as same_range from long where distance is null and value is not null group by all),
judged as (select series, proxy, n > 1 and measured = n and down = up and up <> 0 as monotonic, case when most > 0 then least / most else 0 end as step_ratio, span, coalesce(n_same, 0) as n_same, same_range, slope
  from far left join same using (series, proxy)),
told as (select *, coalesce(monotonic and step_ratio >= 0.25 and n_same >= 4 and span > 2 * same_range, false) as usable from judged)"""


@query(f"""with recursive {_SETS} select series, proxy, coalesce(monotonic, false) as monotonic, round(step_ratio, 6) as step_ratio, round(span, 6) as span, n_same, round(same_range, 6) as same_range, round(slope, 6) as slope, usable,
  usable and not (proxy = 'dyn_range' and coalesce(bool_or(usable and proxy = 'mod_ratio') over (partition by series), false)) as chosen from told""")
def proxies_calibrated(spark, sf_dir):
    """Calibrations of seven users each: the first three recorded at growing distances, the others at one. Level by either proxy, and whether it may be used."""
    r = X.distance_proxies(_frames(spark, sf_dir), "speaker").selectExpr("speaker div 7 as series", "if(speaker % 7 < 3, speaker % 7, null) as distance", "level", "mod_ratio", "dyn_range")
    out = X.calibrated(r, "series", ["mod_ratio", "dyn_range"])
    return out.select("series", "proxy", F.coalesce("monotonic", F.lit(False)).alias("monotonic"), *[F.round(c, 6).alias(c) for c in ("step_ratio", "span")], "n_same", F.round("same_range", 6).alias("same_range"), F.round("slope", 6).alias("slope"), "usable", "chosen")
