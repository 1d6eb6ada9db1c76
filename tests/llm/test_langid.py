"""Language ID: held-out accuracy on the given documents, and defined results on odd rows."""

import random
import re

import pytest
import zstandard
from pyspark.sql import functions as F

from quire.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_rerun(spark):
    rows = langid.op10(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = rows.join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.97
    assert rows.count() == docs.count()
    assert all(0 <= r.score <= 1 for r in held)
    assert sorted(rows.collect()) == sorted(rows.collect())


def test_dictionary_stems_from_many_texts(spark):
    long = [f"mot{c * 4} " * 6000 for c in "abcde"]
    raw = langid.fit(spark.createDataFrame([(t, "fr") for t in long], "text string, lang string"))["fr"]
    assert 32_000 < len(raw) <= 32_768 and all(abs(raw.count(c.encode() * 4) - 820) < 5 for c in "abcde")
    # copies of a text are one text of the sample
    copies = spark.createDataFrame([(f"mot{c * 4}", "fr") for c in "abcde" for _ in range(5)], "text string, lang string")
    assert sum(c.encode() * 4 in langid.fit(copies, per_language=4)["fr"] for c in "abcde") == 4


def test_odd_rows(spark):
    text = "le chat est sur la table et la maison " * 5
    other = "the cat is on the mat and in the house " * 5
    labelled = spark.createDataFrame([(text, "fr"), (other, "en"), (None, "en"), ("x", None), ("", "de"), ("...", "de")], "text string, lang string")
    model = langid.fit(labelled)
    assert sorted(model) == ["en", "fr"]
    rows = [(1, text, "a"), (2, None, "a"), (3, "", "b"), (4, "12 + 3", None), (None, other, "c"), (6, other * 400, "d"), (6, other * 400, "d"), (7, "zzqqww", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = langid.classify(docs, model, keep=("doc_id",)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 8 and by[1].lang_pred == "fr" and by[None].lang_pred == "en" and by[6].lang_pred == "en"
    assert all(by[k].lang_pred == "und" and by[k].score == 0 and by[k].rejected for k in (2, 3, 4))
    assert not by[1].rejected and by[7].rejected
    assert langid.classify(docs.limit(0), model).count() == 0
    nothing = langid.fit(labelled.limit(0))
    assert nothing == {} and {r.lang_pred for r in langid.classify(docs, nothing).collect()} == {"und"}
    alone = langid.fit(labelled.filter(F.col("lang") == "fr"))
    assert {r.score for r in langid.classify(docs.filter("doc_id = 1"), alone).collect()} == {1.0}


def direct(text, model, piece=4096, level=7):
    """Encoded bytes by language: every piece by a compressor of its own, with its dictionary read anew."""
    raw = (" " + re.sub(r"[\W\d_]+", " ", text.lower()) + " ").encode()
    total = {}
    for lang, held in model.items():
        total[lang] = 0
        for at in range(0, len(raw), piece):
            how = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(held), source_size=piece, min_match=3, write_checksum=False, write_content_size=False, write_dict_id=False)
            one = zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            total[lang] += len(one.compress(bytes(128) + raw[at : at + piece]))
    return total


def test_against_direct_compression(spark):
    rng = random.Random(6)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(300)] for lang, letters in (("aa", "abcdeioué"), ("bb", "klmnorstuw"), ("cc", "abeklprsty"))}
    say = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    labelled = spark.createDataFrame([(say(lang, 80), lang) for lang in vocabulary for _ in range(40)], "text string, lang string")
    model = langid.fit(labelled, per_language=30, dictionary_bytes=8000)
    texts = [say(lang, n) for lang in vocabulary for n in (1, 3, 10, 60, 3000)] + [say("aa", 40) + " " + say("bb", 40), "Q", "1 é 2", "KLMNOR, klm-nor! " * 700]
    got = {r.doc_id: r for r in langid.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, text in enumerate(texts):
        sizes = direct(text, model)
        best, second = sorted(sizes.values())[:2]
        assert sizes[got[k].lang_pred] == best, text[:60]
        assert got[k].margin == pytest.approx((second - best) / best) and got[k].rejected == (got[k].margin < 0.02)
    assert any(r.rejected for r in got.values()) and sum(not r.rejected for r in got.values()) > 10
