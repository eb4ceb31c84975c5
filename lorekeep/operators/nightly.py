"""What is made of a day's talk: episodes to beliefs, answers with their sources, texts that may leave."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import with_checkpoints
from .governance import first_match
from .guards import MIN_CLAUSE, MIN_OVERLAP, MIN_SUPPORT, borrowed_dates, contained, content, normal, overlap, similarity, tokens, weakest_clause
from .similar import codes, containing
from .store import Store, linked

#: The fewest words of an episode, the least share of a statement's words that were said, days that one run makes up for, the marker's key.
USABLE_WORDS = 25
STATEMENT_MIN = 0.25
BACKFILL_DAYS = 5
MARKER = "consolidated_through"
#: The share of an old belief's words by which the judge here takes a new one to replace it.
SUPERSEDES_MIN = 0.5
JUDGED_WITHIN_S = 60.0


def certainty(n: Column, recognised: Column) -> Column:
    """Of an episode of n observations, most of them by someone recognised or not."""
    raw = 0.45 + 0.05 * F.least(n - 1, F.lit(6)) + F.when(recognised, 0.10).otherwise(0.0)
    return F.round(F.greatest(F.least(raw, F.lit(0.75)), F.lit(0.35)), 3)


def subject(about: Column) -> Column:
    """One subject in lower case: of several, parted by commas or such signs or by `and`, the first."""
    return F.btrim(F.get(F.split(F.lower(F.btrim(F.coalesce(about, F.lit("")))), r"[,;/]| and "), F.lit(0)))


def supported(rows: DataFrame) -> DataFrame:
    """rows (id, support, lines: texts) with `grounded`: whether any line holds the support or is held by it, or else is like it by MIN_SUPPORT. Only supports that none holds reach Python."""
    held = rows.withColumn("grounded", F.exists(F.coalesce("lines", F.array().cast("array<string>")), lambda x: contained(F.col("support"), x)))
    open_ = held.where(~F.col("grounded") & (normal(F.col("support")) != "")).select("id", "support", F.explode("lines").alias("line"))
    like = open_.where(similarity(normal(F.col("support")), normal(F.col("line"))) >= MIN_SUPPORT).select("id").distinct().withColumn("_like", F.lit(True))
    return held.join(like, "id", "left").withColumn("grounded", F.col("grounded") | F.coalesce("_like", F.lit(False))).drop("_like")


def considered(episodes: DataFrame) -> DataFrame:
    """episodes (id, words, lines, and what was proposed from them: worth, statement, about, support) with the subject, the share of the statement's words that were said, and the first reason why nothing is concluded, or 'ok'."""
    few = F.concat(F.lit("only "), F.col("words").cast("string"), F.lit(" words"))
    nothing = F.length(F.btrim(F.coalesce("statement", F.lit("")))) == 0
    rows = supported(episodes).withColumn("about", subject(F.col("about"))).withColumn("overlap", overlap(F.col("statement"), F.array_join("lines", "\n")))
    reason = first_match(
        (F.col("words") < USABLE_WORDS, few), (~F.coalesce("worth", F.lit(False)), "nothing worth concluding"), (nothing, "said worth but wrote nothing"), (F.col("about") == "", "no subject"),
        (~F.col("grounded"), "not grounded"), (F.col("overlap") < STATEMENT_MIN, "words never said"), default="ok",
    )
    return rows.withColumn("reason", reason)


def supersedes(new: DataFrame, old: DataFrame) -> DataFrame:
    """(about, new, new_at, old, old_at): which old beliefs each new one (id, about, statement, at) makes void, before any of them is replaced.

    The judge that stands in for a hosted model says so where the new statement has SUPERSEDES_MIN of the old one's words, on the same subject and not formed before it.
    Pairs come from a containment join, so only those that can reach it are judged.
    """
    text = lambda rows: rows.select("id", F.col("statement").alias("text"))
    met = containing(text(old), text(new), SUPERSEDES_MIN).select(F.col("line").alias("new"), F.col("quote").alias("old"))
    side = lambda rows, name: rows.select(F.col("id").alias(name), F.col("about").alias(f"{name}_about"), F.col("at").alias(f"{name}_at"))
    judged = met.join(side(new, "new"), "new").join(side(old, "old"), "old")
    return judged.where("new_about = old_about and (old_at < new_at or old_at = new_at and old < new)").select(F.col("new_about").alias("about"), "new", "new_at", "old", "old_at")


def replaced_in_order(pairs: DataFrame) -> DataFrame:
    """(id, replaces) by a fold over pairs (about, new, new_at, old, old_at) of each subject: new beliefs in order of (at, id), each takes the newest of its old ones that none has taken yet out of the candidates of the next.

    A subject's pairs pass one task in order, of which only the ids taken so far are kept; subjects are independent.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.repartition(parts, "about").sortWithinPartitions("about", "new_at", "new", F.desc("old_at"), F.desc("old"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        about, served, taken = None, None, set()
        for pdf in batches:
            out = []
            for a, new, old in zip(pdf["about"], pdf["new"], pdf["old"], strict=True):
                if a != about:
                    about, served, taken = a, None, set()
                if new != served and old not in taken:
                    served = new
                    taken.add(old)
                    out.append((new, old))
            yield pd.DataFrame(out, columns=["id", "replaces"])

    kind = dict(pairs.dtypes)["new"]
    return dealt.select("about", "new", "old").mapInPandas(fold, f"id {kind}, replaces {kind}")


class _Olds:
    """Beliefs of one subject that may still be replaced, the newest last: their words as numbers, one array for all."""

    def __init__(self):
        self.name, self.word, self.start, self.ids, self.live = {}, np.zeros(1024, np.int32), [0], [], []

    def numbers(self, codes) -> np.ndarray:
        return np.fromiter((self.name.setdefault(c, len(self.name)) for c in codes), np.int32)

    def add(self, i, codes) -> None:
        words = self.numbers(codes)
        stop = self.start[-1] + len(words)
        while stop > len(self.word):
            self.word = np.concatenate([self.word, np.zeros_like(self.word)])
        self.word[self.start[-1] : stop] = words
        self.start.append(stop)
        self.ids.append(i)
        self.live.append(True)

    def take(self, codes, least: float):
        """The newest that has `least` of its words among these, which is one no more; None if there is none. Looks at few, then at twice as many as before."""
        words = self.numbers(codes)
        there = np.zeros(len(self.name), bool)
        there[words] = True
        end, size = len(self.ids), 32
        while end:
            begin = max(0, end - size)
            at = np.array(self.start[begin : end + 1])
            hit = np.add.reduceat(there[self.word[at[0] : at[-1]]].astype(np.int64), at[:-1] - at[0])
            good = np.flatnonzero((hit / np.diff(at) >= least) & np.array(self.live[begin:end]))
            if len(good):
                k = begin + int(good[-1])
                self.live[k] = False
                found = self.ids[k]
                if len(self.live) > 64 and sum(self.live) * 2 < len(self.live):
                    self._pack()
                return found
            end, size = begin, size * 2
        return None

    def _pack(self) -> None:
        kept = [k for k, x in enumerate(self.live) if x]
        words = [self.word[self.start[k] : self.start[k + 1]] for k in kept]
        self.word = np.concatenate([*words, np.zeros(1024, np.int32)])
        self.start, self.ids, self.live = [0, *np.cumsum([len(w) for w in words]).tolist()], [self.ids[k] for k in kept], [True] * len(kept)


def replacing(new: DataFrame, old: DataFrame, least: float = SUPERSEDES_MIN) -> DataFrame:
    """replaced_in_order() of supersedes(new, old with new), without their pairs: (id, replaces) for beliefs (id, about, statement, at) of which none is in both.

    A subject's beliefs pass one task in order of (at, id). Each new one looks for what it replaces among those before it that none has taken yet, the newest
    first, and seldom far. What is kept is a number for each of their content words.
    """
    side = lambda rows, fresh: rows.select("about", "at", "id", F.lit(fresh).alias("fresh"), codes(content(F.col("statement"))).alias("own"), F.array_distinct(codes(tokens(F.col("statement")))).alias("said"))
    rows = side(old, False).union(side(new, True)).where("about is not null and at is not null")
    parts = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "about").sortWithinPartitions("about", "at", "id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        about, olds = None, _Olds()
        for pdf in batches:
            out = []
            for a, i, fresh, own, said in zip(pdf["about"], pdf["id"], pdf["fresh"], pdf["own"], pdf["said"], strict=True):
                if a != about:
                    about, olds = a, _Olds()
                taken = olds.take(said.tolist(), least) if fresh else None
                if taken is not None:
                    out.append((i, taken))
                if len(own):
                    olds.add(i, own.tolist())
            yield pd.DataFrame(out, columns=["id", "replaces"])

    kind = dict(new.dtypes)["id"]
    return dealt.select("about", "id", "fresh", "own", "said").mapInPandas(fold, f"id {kind}, replaces {kind}")


def pending(marker: int | None, today: int, most: int = BACKFILL_DAYS) -> tuple[list[int], int]:
    """Days after the marker up to yesterday, the last `most` of them, and how many older ones are skipped; without a marker yesterday alone."""
    if marker is None:
        return [today - 1], 0
    days = list(range(marker + 1, today))
    return days[-most:], max(0, len(days) - most)


def marked(store: Store) -> int | None:
    """The last day that was consolidated."""
    value = store.read("meta").where(F.col("key") == MARKER).agg(F.max_by("value", F.struct("at", F.col("value").cast("long")))).first()[0]
    return None if value is None else int(value)


def run_day(store: Store, episodes: DataFrame, day: int, mark: bool = True) -> dict[str, int]:
    """Consolidates the episodes (day, id, n, recognised, at, sources, and what considered() takes) of one day: how many were written and rejected.

    What is concluded, with its sources, what it replaces and the marker of the day, is one change: a run that dies leaves the day to be done again. A belief that is replaced isn't a
    candidate any more, neither later the same day nor later.
    """
    with_checkpoints(store.spark)
    judged = considered(episodes.where(F.col("day") == day)).withColumn("certainty", certainty(F.col("n"), F.col("recognised"))).checkpoint()
    new = judged.where("reason = 'ok'")
    with store.change(alone=True) as c:
        void = c.read("edges").where("type = 'replaces'").select(F.col("dst").cast("long").alias("id"))
        mine = new.select("id", "about", "statement", "at")
        held = c.read("beliefs").select("id", "about", "statement", F.col("formed_at").alias("at")).join(void, "id", "left_anti")
        current = held.join(mine.select("about").distinct(), "about", "left_semi").select(mine.columns)
        pairs = replacing(mine, current).checkpoint()
        at = float(day)
        c.append("beliefs", new.select("id", F.lit(None).cast("long").alias("owner"), "statement", "about", F.lit("consolidation").alias("author"), "certainty", F.lit(1.0).alias("weight"), F.col("at").alias("formed_at")))
        came = linked(new.select(F.col("id").cast("string").alias("src"), F.explode("sources").alias("dst")), "came-from", at)
        c.append("edges", came.union(linked(pairs.select(F.col("id").cast("string").alias("src"), F.col("replaces").cast("string").alias("dst")), "replaces", at)))
        if mark:
            c.append("meta", store.spark.createDataFrame([(MARKER, str(day), at)], "key string, value string, at double"))
    n = {bool(r["ok"]): r["count"] for r in judged.groupBy((F.col("reason") == "ok").alias("ok")).count().collect()}
    return {"day": day, "written": n.get(True, 0), "rejected": n.get(False, 0)}


def nightly(store: Store, episodes: DataFrame, today: int, ready: bool = True) -> dict:
    """Consolidates every pending day, oldest first. Where the judge isn't ready nothing is done and the marker stays, so the days are taken up by the next run; a second run of a night finds none."""
    days, skipped = pending(marked(store), today)
    if not ready:
        return {"deferred": True, "pending": len(days), "skipped": skipped, "runs": []}
    return {"deferred": False, "pending": 0, "skipped": skipped, "runs": [run_day(store, episodes, day) for day in days]}


def answered(rows: DataFrame) -> DataFrame:
    """rows (id, answer, line, line_id) with the first guard an answer fails and, where it passes all, the id of its source."""
    weakest = weakest_clause(F.col("answer"), F.col("line"))
    verdict = first_match(
        (F.length(F.coalesce("line", F.lit(""))) == 0, "nothing heard"), (overlap(F.col("answer"), F.col("line")) < MIN_OVERLAP, "overlap"), (weakest < MIN_CLAUSE, "clause"),
        (F.size(borrowed_dates(F.col("answer"), F.col("line"))) > 0, "date"), default="ok",
    )
    return rows.select("id", "line_id", verdict.alias("verdict")).select("id", "verdict", F.when(F.col("verdict") == "ok", F.col("line_id")).alias("source"))


def outward(fields: list[str]) -> Column:
    """All text of a payload that would leave, its empty fields left out, in order of the fields' names."""
    parts = F.transform(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(fields)]), lambda x: F.btrim(x))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")


def judged(numbers: Column, candidates: Column) -> Column:
    """A judge's numbers, which count from 1, as places from 0: each once, none out of range, in order."""
    places = F.transform(numbers, lambda x: x - 1)
    return F.array_sort(F.array_distinct(F.filter(places, lambda x: (x >= 0) & (x < candidates))))


def available(outcomes: DataFrame, by: str, now: Column, ttl: float = JUDGED_WITHIN_S) -> DataFrame:
    """Health from the last outcome (at, ok) of each if that is fresh, else that one must probe."""
    last = outcomes.groupBy(by).agg(F.max("at").alias("at"), F.max_by("ok", F.struct("at", "ok")).alias("ok"))
    return last.select(by, first_match((now - F.col("at") > ttl, "probe"), (F.col("ok"), "available"), default="down").alias("health"))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))


def refused(detail: Column) -> Column:
    """Of a call refused for too many: whether waiting helps or the credit is gone."""
    return F.when(_any(detail, fixed.OUT_OF_CREDIT), "out of credit").otherwise("rate limited")


def broke(unavailable: Column, error: Column, ok: Column) -> Column:
    """Did a judge's machinery fail: it says it is unavailable, its error names such a part, or it says it couldn't do the work; an unset ok says nothing."""
    return F.coalesce(unavailable, F.lit(False)) | _any(error, fixed.INFRASTRUCTURE) | F.coalesce(~ok, F.lit(False))


def terminal(text: Column, rose: Column, asked: Column, finished: Column, fell: Column) -> Column:
    """A text with the sign that its sound asks for and its writing lacks.

    A question that only the pitch heard gets a question mark, in place of one full stop, comma or ellipsis at the end. What neither a mark, nor such a question, nor a
    fall ends gets a dash, in place of a comma.
    """
    cut = lambda signs: F.regexp_replace(text, f"[{signs}]$", "")
    question = rose & ~asked
    return F.when(question, F.concat(cut(".,…"), F.lit("?"))).when(~(finished | fell), F.concat(cut(","), F.lit(fixed.UNFINISHED))).otherwise(text)


def gold(questions: DataFrame, turns: DataFrame) -> DataFrame:
    """questions (question, evidence: ids) with their evidence's texts in order of the ids; ids that name nothing are left out."""
    each = questions.select("question", F.explode(F.array_distinct("evidence")).alias("id")).join(turns.select("id", "text"), "id")
    texts = each.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("t"))
    return questions.select("question").join(texts, "question", "left").select("question", F.coalesce(F.transform("t", lambda x: x["text"]), F.array().cast("array<string>")).alias("gold"))
