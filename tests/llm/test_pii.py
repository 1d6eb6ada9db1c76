"""PII: base spans against the plain patterns in Python, disclosing terms on a planted corpus, and odd rows."""

import collections
import math
import random
import re
import time

import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import pii

SF = "/root/testdata/sf0.01"


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(text):
    out = []
    for rank, kind in enumerate(pii.KINDS):
        for m in re.finditer(pii.PLAIN[kind], text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def found(docs):
    return {r.doc_id: [tuple(s)[:4] for s in r.found] for r in pii.find(docs).select("doc_id", "found").collect()}


def test_base_spans_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = found(docs)
    want = {r.doc_id: base(r.text) for r in docs.collect()}
    assert got == want and sum(map(len, want.values())) > 10


def test_base_spans_of_random_texts(spark):
    rng = random.Random(6)
    parts = ["a@b.co", "x.y%z@d-e.f.gh", "@", "a@b", "a@b.c%d@e.fg", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.002.003.004", "4041894974608795", "4041 8949-7460 8795", "404189497460879", "0000000000000", "+1 (386) 555-3733", "+49 30 12345678 ", "+1", "++12-", "+1 2 3 4 5 6 7 8 9) (", " ", "é", "\U0001f600", ".", "-", "7", "55", "x", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    texts += ["".join(rng.choice("1234567890-. +@ab") for _ in range(60)) for _ in range(1500)]
    texts += ["1.2.3.4 " * 700 + "z", "9" * 30000, "a" * 60000, "+5" + " " * 30000, "1-" * 20000, "a.b@" * 8000, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = found(docs)
    for k, t in enumerate(texts):
        assert got[k] == base(t), t


def corpus():
    rng = random.Random(2)
    rows = []
    for k in range(60):
        filler = " ".join(rng.choice(["alpha", "bravo", "candle", "delta", "echoes"]) for _ in range(30))
        if k < 6:
            # three kinds of words near one address: a name that gives it away, one word of all texts, one word of its own
            rows.append((k, f"{filler} Quillon alpha own{'abcdef'[k] * 4} jane@site.org {filler} again Quillon's note"))
        elif k < 9:
            rows.append((k, f"{rows[0][1]}"))
        else:
            rows.append((k, filler))
    return rows


def test_disclosing_terms(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    terms = {r.term: r for r in pii.disclosing(docs, pii.find(docs)).collect()}
    assert set(terms) == {"quillon"} and terms["quillon"].share == pytest.approx(1.0) and terms["quillon"].remove
    # copies of one passage are one context
    copies = docs.filter("doc_id in (0, 6, 7, 8) or doc_id > 8")
    assert pii.disclosing(copies, pii.find(copies)).count() == 0
    for r in pii.spans(docs).collect():
        marks = [r.text[s.start : s.end] for s in r.spans]
        assert marks == (["Quillon", "jane@site.org", "Quillon"] if r.doc_id < 9 else [])
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "jane" not in clean[1] and "uillon" not in clean[1] and "[EMAIL]" in clean[1]
    assert all(clean[k] == t for k, t in corpus() if k > 8)


def test_terms_of_rare_entities(spark):
    rng = random.Random(5)
    words = ["alpha", "bravo", "candle", "delta", "echoes"]
    filler = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(300)]
    # Li next to a@b.co once and far from it in another text; Xu in two contexts of another address; Oz in a copied passage
    filler[0] = f"Li alpha a@b.co {filler[0]}"
    filler[1] = f"bravo a@b.co {filler[1]} {filler[2]} Li"
    filler[3], filler[4] = f"Xu alpha c@d.co {filler[3]}", f"bravo {filler[4]} c@d.co Xu"
    filler[5] = filler[6] = f"Oz alpha e@f.co {filler[5]}"
    docs = spark.createDataFrame(list(enumerate(filler)), "doc_id long, text string")
    got = {(r.value, r.term): r.share for r in pii.disclosing(docs, pii.find(docs)).collect()}
    assert got == {("a@b.co", "li"): pytest.approx(1.0), ("c@d.co", "xu"): pytest.approx(1.0)}
    marks = {r.doc_id: [r.text[s.start : s.end] for s in r.spans] for r in pii.spans(docs).collect()}
    assert marks[1] == ["a@b.co", "Li"] and marks[4] == ["c@d.co", "Xu"] and marks[5] == ["e@f.co"]
    # a term of many documents meets an entity twice by chance
    common = docs.withColumn("text", F.when(F.col("doc_id") % 10 < 5, F.concat("text", F.lit(" xu"))).otherwise(F.col("text")))
    assert "xu" not in {r.term for r in pii.disclosing(common, pii.find(common), generalise_at=0.0).collect()}


def counted(texts, least_contexts, generalise_at, chance, reach=96):
    """Disclosing terms by plain sets over whole texts."""
    words = lambda x: set(re.findall(r"[^\W\d_]{2,}", x.lower()))
    every = [words(t) for t in texts]
    n_term = collections.Counter(w for ws in every for w in ws)
    places = collections.defaultdict(lambda: collections.defaultdict(list))  # entity, document: contexts
    for k, t in enumerate(texts):
        for start, _, end, kind in base(t):
            left, right = t[max(0, start - reach) : start], t[end : end + reach]
            left = re.sub(r"^[^\x20\x09-\x0D]+", "", left) if start > reach else left
            near = (left + " \n " + re.sub(r"[^\x20\x09-\x0D]+$", "", right)).lower()
            places[kind, t[start:end].lower()][k].append(near)
    hashed = lambda x: (xxhash.xxh64(x.encode(), seed=42).intdigest() + 2**63) % 2**64 - 2**63
    out = {}
    for (kind, value), docs in places.items():
        contexts = {c for cs in docs.values() for c in cs}
        for term in set().union(*map(words, contexts)):
            held = [k for k in docs if term in every[k]]
            met = set()
            for k in held:
                met |= {c for c in docs[k] if term in words(c)} or {min(docs[k], key=hashed)}
            if len(met) < 2 or (len(met) < least_contexts and (len(contexts) * n_term[term] / len(texts)) ** (len(met) - 1) / math.factorial(len(met) - 1) > chance):
                continue
            ic = math.log2(len(texts) / len(docs))
            share = math.log2(len(texts) * len(held) / (len(docs) * n_term[term])) / ic if ic > 0 else 0.0
            if share >= generalise_at:
                out[kind, value, term] = share
    return out


@pytest.mark.parametrize("seed,least,at,chance", [(1, 3, 0.8, 0.05), (2, 3, 0.2, 0.05), (3, 2, 0.0, 1.0), (4, 4, 0.3, 0.3)])
def test_terms_against_plain_counts(spark, seed, least, at, chance):
    rng = random.Random(seed)
    names = ["quillon", "Marrow", "Éloi", "tibbet", "okapi", "zephyr", "Nul"]
    values = ["a@b.co", "1.2.3.4", "c@d.org", "+4930123456789", "E@f.gh", "99.1.2.3"]
    texts = []
    for _ in range(140):
        parts = [rng.choice(["alpha", "bravo", "candle", "delta", "x", "9"]) for _ in range(rng.randint(0, 60))]
        for v, name in zip(values, names):
            if rng.random() < 0.06:
                parts[rng.randint(0, len(parts)) : 0] = rng.choice([[name, v], [v, "of", name], [v], [name, *parts[:20], v, v]])
        if rng.random() < 0.1:
            parts.append(rng.choice(names))
        texts.append(" ".join(parts))
    texts += rng.sample(texts, 10)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.kind, r.value, r.term): r for r in pii.disclosing(docs, pii.find(docs), least, at, 0.95, chance).collect()}
    want = counted(texts, least, at, chance)
    want = {(k, re.sub("[^0-9]", "", v) if k == "phone" else v, t): s for (k, v, t), s in want.items()}
    assert set(got) == set(want) and len(want) > 0
    for key, share in want.items():
        assert got[key].share == pytest.approx(share) and got[key].remove == (share >= 0.95)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a@b.co", "x"), (4, "a@b.co", None), (4, "a@b.co", None), (5, "x 4041 8949 7460 8795", "y"), (6, "é\U0001f600 a@b.co é", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = pii.sanitise(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, None, "x"), (2, "", "x"), (None, "[EMAIL]", "x"), (4, "[EMAIL]", None), (4, "[EMAIL]", None), (5, "x [CARD]", "y"), (6, "é\U0001f600 [EMAIL] é", "y")], key=str)
    assert pii.spans(docs.limit(0)).count() == 0 and pii.sanitise(docs.limit(0)).count() == 0
    clash = pii.sanitise(docs.withColumn("spans", F.lit(1)).withColumn("found", F.lit(2)).withColumn("_t", F.lit(3)))
    assert {(r.spans, r.found, r._t) for r in clash.collect()} == {(1, 2, 3)}
    plan = pii.spans(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_text_of_very_many_entities(spark):
    """20,000 addresses in one text: cost in proportion, each text searched once, and the plan holds each pattern once."""
    text = " ".join(f"user{k}@site{k % 7}.org said \u00e9 to" for k in range(20_000)) + " end"
    docs = spark.createDataFrame([(1, text), (2, "nothing here"), (3, "+1 (386) 555-3733 a@b.co")], "doc_id long, text string")
    found = pii.find(docs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == len(pii.KINDS)
    began = time.time()
    got = {r.doc_id: (len(r.found), len(r.spans)) for r in pii.spans(docs).collect()}
    assert got == {1: (20_000, 20_000), 2: (0, 0), 3: (2, 2)}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[1] == "[EMAIL] said \u00e9 to " * 19_999 + "[EMAIL] said \u00e9 to end" and clean[3] == "[PHONE] [EMAIL]"
    assert time.time() - began < 120


def test_overlapping_spans_become_one(spark):
    texts = ["1.2.3.4@5.6.7.8 x", "+4041894974608795 and 4041894974608795@a.b", "a@b.c" * 300, "x" * 5000 + " a@b.co " + "y" * 9000 + " 1.2.3.4", ""]
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        out, at = "", 0
        for start, _, end, kind in base(text):
            if start >= at:
                out += text[at:start] + f"[{kind.upper()}]"
            at = max(at, end)
        assert got[k] == out + text[at:]
