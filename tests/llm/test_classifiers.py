"""Quality rules, toxicity and language ID: statistics by brute force, verdicts by held-out accuracy, and odd input."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from staleguard.llm import langid, quality, queries, toxicity
from staleguard.llm.arrowtext import utf8
from staleguard.llm.linear import HashedNgrams
from staleguard.sources.tables import load

SF = "/root/testdata/sf0.01"


def brute_statistics(text):
    words = re.findall("[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics_are_exact():
    r = random.Random(2)
    texts = ["".join(r.choice("aé b\n\n#\tx日 ") for _ in range(r.randrange(0, 80))) for _ in range(400)] + ["", "\n", "a", "a\na", "x " * 5000]
    got = quality.statistics(*utf8(pa.array(texts, pa.large_string())))
    assert [tuple(int(got[k][i]) for k in quality.STATISTICS) for i in range(len(texts))] == [brute_statistics(t) for t in texts]


def test_quality_without_labels_keeps_what_the_rules_keep(spark):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(1, good, 0.1), (1, good, 0.1), (2, "too few", 0.2), (3, None, 0.3), (4, "a b c " * 40, 0.4), (None, good, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit_quality(df, labels)
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [1, 1, None]
    assert [r["base_failed"] for r in quality.score_quality(df, model).orderBy("doc_id").collect()] == [False, False, False, True, True, True]
    assert quality.keep_good(df.limit(0), model).count() == 0


def test_quality_on_rows_it_was_not_fitted_on(spark):
    docs = load(spark, SF, "documents", "doc_id", "text")
    labels = load(spark, SF, "labels", "doc_id", "quality")
    model = quality.fit_quality(docs, labels.filter("doc_id % 2 = 0"))
    got = quality.score_quality(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed") \
        .groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in got}
    assert kept[1] >= 0.98 and kept.get(0, 0) <= 0.2


def test_toxicity_on_its_held_out_fold(spark):
    got = queries.QUERIES["op7_compression_toxicity"](spark, SF)
    labels = load(spark, SF, "labels", "doc_id", "toxic").dropna()
    seen = {(r["toxic"], r["predicted"]): r["count"] for r in got.filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert seen.get((0, 1), 0) <= 1 and seen[1, 1] >= 4 * seen.get((1, 0), 0)
    assert got.filter("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
    assert got.count() == load(spark, SF, "documents").count()


def test_toxicity_of_odd_input(spark):
    rows = [(1, None), (2, ""), (3, "plain words"), (None, "x"), (3, "plain words"), (4, "long " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("predicted", F.lit("taken"))
    unlearned = toxicity.fit_toxicity(df, spark.createDataFrame([(1, None), (3, 0)], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score_toxicity(df, unlearned).collect()} == {0.0}
    base, toxic = toxicity.dictionaries([b"some words and vile speech " + str(k).encode() for k in range(99)], [b"some words and calm speech " + str(k).encode() for k in range(99)])
    model = toxicity.ToxicityModel(base, toxic, (1.0, 1.0, 1.0, 1.0), -1.0)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(df, model).collect()}
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores.values()) and scores[1] == scores[2]
    assert toxicity.keep_ordinary(df, model).columns == df.columns and toxicity.score_toxicity(df.limit(0), model).count() == 0


def test_windows_cover_whole_texts():
    n = [1, 63, 64, 65, 96, 97, 5000]
    marked = toxicity.dictionaries(*([f"{chr(97 + k % 26) * 2}{chr(97 + k // 26)} {w} y".encode() for k in range(200)] for w in ("vilest", "kindly")))
    assert b"vilest" in marked[1]
    calm = "kindly x 1 y kindly x 2 y kindly x 33 y "
    for size in n[3:]:
        text = (calm * 200)[:size] + " vilest kindly x 1 y kindly x 2 y"
        assert toxicity.evidence(pa.array([text], pa.large_string()), *marked)[0, 0] > 0


def test_codewords_are_far_apart():
    for k in (2, 3, 4, 6, 9, 40):
        code = langid.codewords(k)
        apart = (code[:, None] != code[None]).sum(axis=2) + 1000 * np.eye(k, dtype=int)
        assert apart.min() >= max(1, code.shape[1] // 4) and (code.min(axis=0) < code.max(axis=0)).all()


def test_languages_of_held_out_documents(spark):
    got = queries.QUERIES["op8_language_codes"](spark, SF).join(load(spark, SF, "documents", "doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang_pred = lang").count() >= 0.98 * got.count()


def test_many_languages_use_random_codes(spark):
    r = random.Random(1)
    letters = {f"l{k}": "".join(r.sample("abcdefghijklmnopqrstuvwxyzàéîöü", 5)) for k in range(9)}
    rows = [(i, " ".join("".join(r.choice(letters[f"l{i % 9}"]) for _ in range(6)) for _ in range(30)), f"l{i % 9}") for i in range(360)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify_languages(df, langid.fit_languages(df.filter("doc_id < 270"))).join(df, "doc_id").filter("doc_id >= 270")
    assert got.filter("lang_pred = lang").count() >= 85


def test_language_of_odd_input(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 34 !", None), (4, "日本", None), (5, "the the", "en"), (None, "the", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = {r["doc_id"]: r["lang_pred"] for r in langid.identify_languages(df, langid.fit_languages(df)).collect()}
    assert one == {1: "und", 2: "und", 3: "und", 4: "en", 5: "en", None: "en"}
    none = langid.identify_languages(df, langid.fit_languages(df.limit(0))).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and {r["score"] for r in none} == {0.0}
    assert langid.identify_languages(df.limit(0), langid.LanguageModel(HashedNgrams(char_orders=(1,)))).count() == 0
