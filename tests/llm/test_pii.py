import hashlib
import math
import random
import re

from lorekeep.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(x) <= 255 for x in m.group().split(".")),
        "card": lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m)),
        "phone": lambda m: 9 <= len(digits(m)) <= 15,
    }
    spans = {k: [(m.start(), m.end()) for m in p.finditer(text or "") if ok[k](m)] for k, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))}
    told = ",".join(f"{k}:{a}:{b}" for k, v in spans.items() for a, b in v)
    return (*[len(v) for v in spans.values()], hashlib.sha256(told.encode()).hexdigest(), told)


def same(frame, rows):
    got = sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in P.pii_table(frame).collect()), key=str)
    assert got == sorted(((i, *brute(t)[:5]) for i, t in rows), key=str)


def test_whole_table(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    same(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])
    told = {r["doc_id"]: brute(r["text"])[5] for r in docs.collect()}
    for r in P.pii_table(docs).collect():
        assert ",".join(s for s in r["spans"].split(",") if not s.startswith("term:")) == told[r["doc_id"]]


def test_against_python_patterns(spark):
    rng = random.Random(9)
    bits = ["a@b.c", "x.y+z@q-r.com", "a@b.c_d@e.f", "@", "..", "1.2.3.4", "256.1.1.1", "01.002.3.255", "1.2.3.4.5.6.7.8", "9" * 30, "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "+1 (743) 555-3824", "+49 30 1234", "+1", "é", "\U0001f600", " ", "\n", "-", "%", "a", "_", "0.0.0.99999999999999999999"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 25)))) for k in range(400)]
    rows += [(900, "1 " * 30_000), (901, "a" * 60_000 + "@"), (902, "9" * 50_000), (903, "a@b" + ".c" * 20_000), (904, "+" * 5000 + "1" * 5000)]
    same(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_terms_that_reveal(spark):
    rows = [(k, f"Write to Zebedee anna@x.org about the common letter number {k}.") for k in range(6)]
    rows += [(100 + k, f"A common letter about other matters, number {k}.") for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in P.pii_table(frame).collect()}
    for k in range(6):
        text = rows[k][1]
        terms = [s.split(":") for s in got[k]["spans"].split(",") if s.startswith("term:")]
        named = {text[int(a) : int(b)] for _, a, b in terms}
        assert "Zebedee" in named and not named & {"common", "letter", "about", "number"}
        assert got[k]["spans"].startswith(brute(text)[5])
    assert all(got[100 + k]["spans"] == "" for k in range(40))
    clean = {r["doc_id"]: r["text"] for r in P.sanitised(frame).collect()}
    assert "Zebedee" not in clean[3] and "[EMAIL]" in clean[3] and clean[3].endswith("common letter number 3.") and clean[105] == rows[11][1]


def test_terms_of_entities_in_one_or_two_documents(spark):
    rows = [(0, "Write to Zebedee anna@x.org about the common letter.")]
    rows += [(k, f"Call Quillon at +1 (743) 555-3824 about the common letter {k}.") for k in (1, 2)]
    rows += [(100 + k, f"Write to them or call at noon about the common letter {k}.") for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in P.pii_table(frame).collect()}
    for k, name in ((0, "Zebedee"), (1, "Quillon"), (2, "Quillon")):
        terms = [s.split(":") for s in got[k].split(",") if s.startswith("term:")]
        assert {rows[k][1][int(a) : int(b)] for _, a, b in terms} == {name}
    assert all(got[100 + k] == "" for k in range(40))


def test_terms_far_away_and_everywhere(spark):
    rows = [(0, "Zebedee " + "wrote a common letter about it, " * 30 + "to anna@x.org and so did (Zebedee).")]
    rows += [(1, "No address here, but 'ZEBEDEE' wrote a common letter about it to them and so did others.")]
    rows += [(100 + k, f"They wrote a common letter here, about no address, but to others and so did {k}.") for k in range(400)]
    rows += [(900, "Common letter " * 30_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in P.pii_table(frame).collect()}
    for k, n in ((0, 2), (1, 1)):
        terms = [tuple(map(int, s.split(":")[1:])) for s in got[k].split(",") if s.startswith("term:")]
        assert terms == [m.span() for m in re.finditer("(?i)zebedee", rows[k][1])] and len(terms) == n
    assert all(s == "" for k, s in got.items() if k >= 100)
    clean = {r["doc_id"]: r["text"] for r in P.sanitised(frame).collect()}
    assert not any("zebedee" in t.lower() for t in clean.values()) and clean[900] == rows[-1][1]


def test_disclosures_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in ("rn", "x", "Ö", "lé")]
    people = [f"p{k}@x.org" for k in range(40)]
    rows = [(k, " ".join([*rng.choices(words, [1 / (1 + j) for j in range(len(words))], k=12), *rng.sample(people, rng.choice([0, 0, 1, 2]))])) for k in range(200)]
    sets = [({w.lower() for w in t.split() if "@" not in w and len(w) > 2}, {w for w in t.split() if "@" in w}) for _, t in rows]
    n, told = len(rows), {}
    for e in people:
        with_e = [w for w, p in sets if e in p]
        for t in set().union(*with_e):
            n_t = sum(t in w for w, _ in sets)
            gain = math.log2(sum(t in w for w in with_e) * n / (len(with_e) * n_t)) / math.log2(n / len(with_e))
            if gain >= P.GENERALISE:
                told[t] = max(gain, told.get(t, 0))
    assert told
    want = {k: [(m.start(), m.end(), round(told[m.group().lower()], 9)) for m in re.finditer(r"(?<!\S)[^\W\d_]{3,}(?!\S)", t) if m.group().lower() in told] for k, t in rows}
    found = P.find(P.numbered(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    got = {r["doc_id"]: [(s["start"], s["end"], round(s["disclosure"], 9)) for s in r["term"]] for r in found}
    assert got == want


def test_odd_rows(spark, odd, empty):
    same(odd, [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()])
    assert P.pii_table(empty).count() == 0 and P.sanitised(odd).count() == 11
