import hashlib
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodestone.llm.personal_data import CONTEXT, find_personal_data, sanitise

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end(), m[0]))
    return out


def slow(texts):
    """Base spans and terms of all texts, by plain loops."""
    n_t, n_te = Counter(), Counter()
    beside = defaultdict(set)
    for text in texts:
        n_t.update(re.findall(r"(?<![^\W\d_])[^\W\d_]{4,}", text.lower()))
        own = set()
        for kind, s, e, v in base(text):
            for m in re.finditer(r"[^\W\d_]+", text):
                # words cut by the span itself count as what is left of them beside it
                for a, b in ((m.start(), min(m.end(), s)), (max(m.start(), e), m.end())):
                    if b - a >= 4 and (b <= s and a >= s - CONTEXT or a >= e and b <= e + CONTEXT):
                        own.add((f"{kind}:{v.lower()}", text[a:b].lower(), a, b))
        n_te.update((e, t) for e, t, _, _ in own)
        beside[text] |= own
    n_e, total = Counter(f"{kind}:{v.lower()}" for text in texts for kind, _, _, v in base(text)), sum(n_t.values())
    # one occurrence more than was seen, not with the entity; at most a bit is left, and a fifth of what the entity has
    left = lambda e, t: -math.log2(min(1, n_te[e, t] / (n_t[t] + 1)))
    told = {(e, t) for e, t in n_te if n_t[t] and left(e, t) <= min(1, -0.2 * math.log2(min(1, n_e[e] / total)) + 1e-12)}
    names = {t for _, t in told}
    out = {}
    for text in texts:
        spans = base(text)
        places = {(a, b) for e, t, a, b in beside[text] if (e, t) in told}
        places |= {m.span() for m in re.finditer(r"[^\W\d_]+", text) if m[0].lower() in names}
        out[text] = spans, sorted((a, b) for a, b in places if not any(s < b and a < f for _, s, f, _ in spans))
    return out


FILL = [f"common filler words number {w} follow here today" for w in ("alpha", "beta", "gamma", "delta")]
TEXTS = [
    "Write to Jane.Doe@example.com or to x@y@z.com, a@b.c_d@e.f now",
    "Galbraith, the beekeeper, answers at bee.keeper@example.org today",
    "Ask the beekeeper Galbraith common filler (bee.keeper@example.org) for honey",
    "GALBRAITH sells honey in the village",
    "ips 1.2.3.4.5.6.7.8 and 256.1.1.1 and 0001.02.3.255, 10.0.0.1x",
    "cards 4111 1111 1111 1111, 4111-1111-1111-1112 5500005555555559 123",
    "call +1 (415) 555-2671 or +12 3 or +49.30.123456-78 ext, +1234567890123456",
    "Éloïse 🙂 calls +33 1 23 45 67 89 naïvement über 10.1.2.3",
    "", " \n", "@@@ ... +++ 1 2 3", "no data at all here",
    *FILL,
]


def test_equal_to_plain_loops(spark):
    rows = [(i, t, "e") for i, t in enumerate(TEXTS)] + [(100, None, "e"), (None, TEXTS[2], "e"), (1, TEXTS[1], "e"), (1, TEXTS[1], "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    want = slow([t or "" for _, t, _ in rows])
    got = find_personal_data(docs).collect()
    assert len(got) == len(rows)
    some = False
    for r in got:
        text = TEXTS[2] if r.doc_id is None else (TEXTS + [""] * 100)[r.doc_id]
        spans, terms = want[text]
        names = [f"{k}:{s}:{e}" for k, s, e, _ in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest(), text
        assert r.spans == ",".join(names + [f"term:{s}:{e}" for s, e in terms]), text
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in spans) for x in BASE)
        some |= bool(terms)
    assert some
    assert find_personal_data(docs.limit(0)).count() == 0


def test_very_long_texts(spark):
    long = ["1" * 60000, "a" * 60000, "1 " * 30000, "+" + "1-" * 20000 + "1", "1." * 30000, "a.b" * 20000 + "@x.com", "a@b.c " * 1500]
    got = {r.doc_id: r for r in find_personal_data(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")).collect()}
    assert got[5].n_email == 1 and got[6].n_email == 1500
    assert [got[i].n_card for i in range(4)] == [0, 0, 0, 0]


def test_sanitised_texts(spark):
    rows = [(1, TEXTS[1], "de"), (2, TEXTS[2], None), (3, "plain", "x"), (4, None, "x"), (5, "card +4111 1111 1111 1111 end", "x"), (1, TEXTS[1], "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = sanitise(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id, r.text) for r in out.collect() if r.text)
    assert len(got) == 5 and out.count() == 6
    assert got[0] == got[1] and "bee.keeper" not in got[0][1] and "[EMAIL]" in got[0][1]
    assert got[3] == (3, "plain") and got[4][1].startswith("card +[CARD]")
    assert sanitise(docs.limit(0)).count() == 0


def test_terms_go_wherever_they_stand_and_verdicts_dont_drift(spark):
    texts = TEXTS[1:3] + ["Galbraith sells honey in the village", "honey from another village, today", *FILL * 5]
    one = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in sanitise(one).collect()}
    assert not any("galbraith" in t.lower() for t in clean.values()) and "village" in clean[3]
    # twice the corpus, same spans
    find = lambda df: {r.doc_id: r.spans for r in find_personal_data(df).collect()}
    assert find(one) == find(one.unionByName(one))
    # columns named like those at work, in any case
    odd = one.withColumn("Digest", F.lit("mine")).withColumn("spans", F.lit(1)).withColumn("_terms", F.lit(None).cast("int"))
    assert sanitise(odd).columns == odd.columns and {r.Digest for r in sanitise(odd).collect()} == {"mine"}


def test_terms_beyond_the_broadcast_bound(spark, monkeypatch):
    from lodestone.llm import personal_data

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = sorted(map(tuple, find_personal_data(docs).collect()))
    monkeypatch.setattr(personal_data, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, find_personal_data(docs).collect())) == want
