"""PII by information-theoretic sanitisation: base patterns give the protected entities, corpus co-occurrence the terms that reveal them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_enough, written

#: A term discloses an entity when it gives away this part of the entity's information, PMI(entity, term) / IC(entity): from GENERALISE on it is replaced by a placeholder, from REMOVE on it is removed.
GENERALISE = 0.8
REMOVE = 0.95

# The base patterns, in the order of kinds. Each is written for Java so that it finds the same leftmost matches in
# linear time: a run of the first class is tried only at its start or where the last match ended, and runs aren't given back
# where what follows them can't begin inside the run.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}
_SIGN = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: A term: a run of three letters or more, wherever it stands outside e-mail addresses; the other kinds of entities hold no letters.
TERM = r"\p{L}{3,}"
#: Places are gathered in blocks of so many, so that a long text costs in proportion to its length.
BLOCK = 64

_SPAN = "array<struct<start:int,end:int,value:string>>"
_PLACES = "array<struct<start:int,end:int,disclosure:double>>"


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        # a part of up to three digits once leading zeros are gone, and 255 at most
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _found(kind: str, text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    none = F.array().cast("array<string>")
    return F.when(F.contains(text, F.lit(_SIGN[kind])), found).otherwise(none) if _SIGN[kind] else found


def _placed(kind: str, text: Column, found: Column) -> Column:
    """Spans of the matches. Places are sums of the lengths of what lies between and of matches."""
    spans = _gathered(F.split(text, PATTERNS[kind], -1), found, _SPAN, lambda value, start, end: (_passes(kind, value), F.struct(start.alias("start"), end.alias("end"), value.alias("value"))))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(_SPAN))


def _gathered(between: Column, found: Column, kind: str, of) -> Column:
    """The places of the matches for which `of` (value, start, end) gives true and a struct, in an array of this kind. Both arrays are made once for a text."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("block"), F.array().cast(f"array<{kind}>").alias("full"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["value"]), F.lit(0))
        good, one = of(x["value"], start, end)
        kept = x["value"].isNotNull() & good
        over = F.size(s["block"]) >= BLOCK
        block = F.when(~kept, s["block"]).when(over, F.array(one)).otherwise(F.concat(s["block"], F.array(one)))
        full = F.when(kept & over, F.concat(s["full"], F.array(s["block"]))).otherwise(s["full"])
        return F.struct(end.alias("at"), block.alias("block"), full.alias("full"))

    matches = F.zip_with(between, found, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    return F.aggregate(matches, zero, step, lambda s: F.concat(F.flatten(s["full"]), s["block"]))


def _places(plain: Column, hits: Column) -> Column:
    """(start, end, disclosure) of those terms of a text without addresses that hits (pos, disclosure) name by their numbers, in order. Only lengths are summed up in between."""
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.lit(0).alias("h"), F.array().cast(_PLACES).alias("block"), F.array().cast(f"array<{_PLACES}>").alias("full"))

    def step(s: Column, x: Column) -> Column:
        start, hit = s["at"] + x["gap"], F.get(hits, s["h"])
        kept, over = F.coalesce(hit["pos"] == s["i"], F.lit(False)), F.size(s["block"]) >= BLOCK
        one = F.array(F.struct(start.alias("start"), (start + x["word"]).alias("end"), hit["disclosure"].alias("disclosure")))
        block = F.when(~kept, s["block"]).when(over, one).otherwise(F.concat(s["block"], one))
        full = F.when(kept & over, F.concat(s["full"], F.array(s["block"]))).otherwise(s["full"])
        return F.struct((s["i"] + 1).alias("i"), (start + x["word"]).alias("at"), (s["h"] + kept.cast("int")).alias("h"), block.alias("block"), full.alias("full"))

    lengths = F.zip_with(F.split(plain, TERM, -1), _words(plain), lambda gap, word: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(word), F.lit(0)).alias("word")))
    return F.aggregate(lengths, zero, step, lambda s: F.concat(F.flatten(s["full"]), s["block"]))


def _words(plain: Column) -> Column:
    return F.regexp_extract_all(plain, F.lit(TERM), F.lit(0))


def _terms(plain: Column) -> Column:
    """The terms of a text without addresses, each once."""
    return F.array_distinct(F.transform(F.array_distinct(_words(plain)), F.lower))


def _plain(text: Column, emails: Column) -> Column:
    """The text with blanks for its addresses, so that places stay."""
    blank = F.zip_with(F.split(text, _EMAIL, -1), emails, lambda gap, value: F.concat(gap, F.coalesce(F.repeat(F.lit(" "), F.length(value)), F.lit(""))))
    return F.when(F.size(emails) > 0, F.array_join(blank, "")).otherwise(text)


def base_spans(docs: DataFrame) -> DataFrame:
    """docs (rid, doc_id, text) with a column of spans for each kind, and `plain`, the text with blanks for addresses."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("rid", "doc_id", text.alias("text"), *[_found(k, text).alias(f"m_{k}") for k in KINDS])
    return rows.select("rid", "doc_id", *[_placed(k, F.col("text"), F.col(f"m_{k}")).alias(k) for k in KINDS], _plain(F.col("text"), F.col("m_email")).alias("plain"))


def _near(side: DataFrame, row_bytes: int) -> DataFrame:
    """A written side to broadcast behind a size check; beyond it joins shuffle."""
    return F.broadcast(side) if small_enough(side.count(), row_bytes) else side


def disclosures(base: DataFrame, total: int) -> DataFrame:
    """(entity, term, disclosure) of all pairs from GENERALISE on.

    base: (rid, the spans of each kind, plain). All numbers are documents of the whole corpus: n(e) with the entity, n(t) with the term,
    n(e, t) with both, anywhere in them; disclosure = log2(n(e, t) N / (n(e) n(t))) / log2(N / n(e)). As n(e, t) is n(e) at most, a pair can
    reach GENERALISE only where log2(N / n(t)) >= GENERALISE log2(N / n(e)); pairs that can't are left out before they are made, which changes
    no result. Only rows with entities make pairs; all counts are combined before they are shuffled. Entities and terms of one
    document are scored like all others.
    """
    values = F.array_distinct(F.concat(*[F.transform(k, lambda s, k=k: F.concat(F.lit(f"{k}:"), s["value"])) for k in KINDS]))
    held = base.where(F.greatest(*[F.size(k) for k in KINDS]) > 0)
    entities = held.select("rid", F.explode(values).alias("entity"))
    n = F.lit(float(max(total, 1)))
    of_entity = entities.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") < total)
    of_entity = written(of_entity.withColumn("bits", F.log2(n / F.col("n_entity"))), "pii-entities")
    # a hair below the bound, so that rounding leaves nothing out
    least = GENERALISE * (of_entity.agg(F.min("bits")).first()[0] or 0.0) - 1e-9
    words = lambda rows: rows.select("rid", F.explode(_terms(F.col("plain"))).alias("term"))
    of_term = words(base).groupBy("term").agg(F.count("*").alias("n_term")).withColumn("rare", F.log2(n / F.col("n_term"))).where(F.col("rare") >= least)
    of_term = written(of_term.join(words(held).select("term").distinct(), "term", "left_semi"), "pii-terms")
    left = written(entities.join(_near(of_entity, 128), "entity"), "pii-left")
    right = written(words(held).join(_near(of_term, 64), "term"), "pii-right")
    pairs = left.join(right, "rid").where(F.col("rare") >= GENERALISE * F.col("bits") - 1e-9)
    both = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    gain = F.log2(F.col("n_both") * n / (F.col("n_entity") * F.col("n_term"))) / F.log2(n / F.col("n_entity"))
    return both.select("entity", "term", gain.alias("disclosure")).where(F.col("disclosure") >= GENERALISE)


def find(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (rid, doc_id, text): rid, doc_id, the spans of each kind and `term`: (start, end, disclosure) of terms to generalise or remove.

    A term that discloses any entity is marked wherever it stands, in all rows, with its highest disclosure. A null text counts as empty.
    Base spans always stay; terms never overlap them. Rows are told apart by rid, so repeated rows and doc_ids do no harm; with no
    entity anywhere there are no terms. Texts are gone through for places in those rows only that hold a term to mark.
    """
    base = written(base_spans(docs), "pii-base")
    total = base.count()
    told = written(disclosures(base, total).groupBy("term").agg(F.max("disclosure").alias("disclosure")), "pii-disclosures")
    words = base.select("rid", F.posexplode(_words(F.col("plain"))).alias("pos", "word")).select("rid", "pos", F.lower("word").alias("term"))
    hits = words.join(_near(told, 64), "term").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", "disclosure"))).alias("hits"))
    hits = written(hits, "pii-hits")
    few = small_enough(hits.agg(F.sum(F.size("hits") + 1)).first()[0] or 0, 32)
    terms = base.select("rid", "plain").join(F.broadcast(hits) if few else hits, "rid").select("rid", _places(F.col("plain"), F.col("hits")).alias("term"))
    none = F.array().cast("array<struct<start:int,end:int,disclosure:double>>")
    return base.drop("plain").join(terms, "rid", "left").withColumn("term", F.coalesce("term", none))


def numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")


def pii_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    told = lambda k: F.transform(k, lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string")))
    base = F.concat_ws(",", *[told(k) for k in KINDS])
    found = find(numbered(docs))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), F.concat_ws(",", *[told(k) for k in (*KINDS, "term")]).alias("spans"), F.size("term").cast("long").alias("n_term"))


def sanitised(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with every base span and every generalised term replaced by its kind in brackets, and terms that give an entity away removed.

    Spans of different kinds may overlap; then the one that starts first, of these the longest, is replaced. The rows are written with
    their numbers first, for they are read twice.
    """
    rows = written(numbered(docs), "pii-rows")
    cut = lambda k: F.transform(k, lambda s: F.struct(s["start"], (-s["end"]).alias("end"), F.lit(f"[{k.upper()}]").alias("by")))
    spans = [cut(k) for k in KINDS]
    spans.append(F.transform("term", lambda s: F.struct(s["start"], (-s["end"]).alias("end"), F.when(s["disclosure"] >= REMOVE, "").otherwise("[TERM]").alias("by"))))
    found = find(rows).select("rid", F.array_sort(F.concat(*spans)).alias("cuts"))
    text = F.coalesce(F.col("text"), F.lit(""))

    def step(s: Column, x: Column) -> Column:
        kept = F.concat(s["out"], F.substring(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0))), x["by"])
        over = x["start"] < s["at"]
        return F.struct(F.when(over, s["at"]).otherwise(-x["end"]).alias("at"), F.when(over, s["out"]).otherwise(kept).alias("out"))

    done = F.aggregate("cuts", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    out = F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    return rows.join(found, "rid").select("doc_id", out.alias("text"))


