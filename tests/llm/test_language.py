"""String-kernel language identification: held-out accuracy, what enters a prediction, edges."""

import zlib

import numpy as np

from receivables.llm import language, registry

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.queries()["op6_string_kernel_language"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.lang_pred in {"en", "fr", "de", "es"} for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in out) >= 0.98 * len(out)


def test_held_out_labels_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(language.held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    a, b = (sorted(language.language_rows(d).collect()) for d in (docs, other))
    assert a == b


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !! \t", "fr"), (4, "hello there", None), (None, "bonjour le monde", "fr"),
            (6, "the cat and the dog", "en"), (6, "the cat and the dog", "en"), (9, "a\0b", "en"), (10, "мир " * 20_000, "en"), (11, "İ" * 50, "fr")]
    df = spark.createDataFrame([(*r, "s", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = language.language_rows(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1, 2, 3))
    assert by[4].lang_pred in {"en", "fr"} and by[None].lang_pred == "fr" and by[None].held_out is False
    assert len({tuple(r) for r in got if r.doc_id == 6}) == 1
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.language_rows(unlabelled).collect()] == ["und"]
    one = spark.createDataFrame([(3, "some text", "en")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.language_rows(one).collect()] == ["en" if zlib.crc32(b"3") % 3 != 1 else "und"]
    assert language.language_rows(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def exact_grams(text):
    clean = "".join(c if c.isalpha() else " " for c in text.lower())
    while "  " in clean:
        clean = clean.replace("  ", " ")
    return {clean[i : i + n] for n in (1, 2, 3) for i in range(len(clean) - n + 1)}


def test_whole_result_against_a_direct_solution(spark):
    """Landmarks, weights, ridge and scores of every row, from exact sets of n-grams and the ridge's normal equations in the
    space of the landmarks (no whitening)."""
    rng = np.random.default_rng(11)
    words = {lang: ["".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(60)] for lang, letters in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "abijmnop"))}
    langs = ["aa"] * 150 + ["bb"] * 110 + ["cc"] * 20
    rows = [(k, " ".join(rng.choice(words[lang], 12 if k % 6 else 2)), lang if k % 10 else None) for k, lang in enumerate(langs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    hashes = {r.doc_id: (r.h, r.g) for r in df.selectExpr("doc_id", "xxhash64(doc_id, text) h", "xxhash64(text, doc_id) g").collect()}
    learned = sorted((lang, hashes[k], k) for k, _, lang in rows if lang and zlib.crc32(str(k).encode()) % 3 != 1)
    names = sorted({lang for lang, *_ in learned})
    marks = [x for name in names for x in [r for r in learned if r[0] == name][: language.LANDMARKS]]
    assert len(marks) < len(learned) and len({sum(r[0] == n for r in learned) for n in names}) == 3
    sets = {k: exact_grams(text) for k, text, _ in rows}
    kernel = lambda a, b: np.array([[len(sets[x] & sets[y]) / (len(sets[x]) * len(sets[y])) ** 0.5 for y in b] for x in a])
    m = [k for *_, k in marks]
    values = np.hstack([kernel([k for *_, k in learned], m), np.ones((len(learned), 1))])
    penalty = np.zeros((len(m) + 1, len(m) + 1))
    penalty[:-1, :-1], penalty[-1, -1] = kernel(m, m), 1
    target = np.array([[1.0 if lang == name else -1.0 for name in names] for lang, *_ in learned])
    weight = np.array([[1 / sum(r[0] == lang for r in learned)] for lang, *_ in learned])
    solved = np.linalg.solve(values.T @ (weight * values) + language.RIDGE * penalty, values.T @ (weight * target))
    margin = np.hstack([kernel([k for k, *_ in rows], m), np.ones((len(rows), 1))]) @ solved
    got = {r.doc_id: r for r in language.language_rows(df).collect()}
    assert len(got) == len(rows)
    for (k, *_), found in zip(rows, margin):
        second, best = np.sort(found)[-2:]
        assert abs(got[k].score - 1 / (1 + np.exp(-2 * best))) < 2e-3
        assert got[k].lang_pred == names[found.argmax()] or best - second < 1e-2


def test_long_text_in_a_large_alphabet():
    """More distinct n-grams than any fixed number of slots: kernel values are those of the exact sets."""
    rng = np.random.default_rng(8)
    chinese, other = ("".join(map(chr, rng.integers(0x4E00, 0x9FA0, n))) for n in (200_000, 300))
    texts = [chinese, other, "Ab  ab", "the cat, the dog", "", "a\0b", "\U0010fffd"]

    sets, found = [exact_grams(t) for t in texts], language.grams(texts)
    assert [len(x) for x in found] == [len(s) for s in sets] and len(sets[0]) > 300_000
    want = [[len(a & b) / max(1, len(a) * len(b)) ** 0.5 for b in sets] for a in sets]
    assert np.allclose(language.Landmarks(found).kernel(found), want, atol=1e-5)


def test_prediction_for_a_long_text(spark):
    """Two languages of one script: long texts go by their own n-grams, not by the landmarks."""
    rng = np.random.default_rng(9)
    text = lambda lo, n: "".join(map(chr, rng.integers(lo, lo + 5000, n)))
    rows = [(i, text((0x4E00, 0x6E00)[i % 2], 3000), ("aa", "bb")[i % 2]) for i in range(60)]
    rows += [(1000 + i, text((0x4E00, 0x6E00)[i % 2], 150_000), None) for i in range(4)]
    got = {r.doc_id: r.lang_pred for r in language.language_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[1000 + i] for i in range(4)] == ["aa", "bb", "aa", "bb"]
