import numpy as np
import pyarrow as pa

from rollbook.llm import catalog, langid

from ..conftest import DATA


def test_held_out_accuracy(spark):
    root = DATA.replace("0.001", "0.01")
    found = {r["doc_id"]: r for r in catalog.QUERIES["op4_language"](spark, root).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "lang").collect()}
    assert found.keys() == truth.keys()
    tests = [found[d]["lang_pred"] == lang for d, lang in truth.items() if found[d]["held_out"]]
    assert len(tests) > 100 and np.mean(tests) > 0.95
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in set(truth.values()) for r in found.values())


def test_subwords_do_not_depend_on_neighbours():
    texts = pa.array(["Ab c", None, "", "12 \u0301!", "déjà vu", "x", "Ab c"])
    bucket, counts = langid.subwords(texts)
    parts = np.split(bucket, counts.cumsum()[:-1])
    for i in range(len(texts)):
        alone, _ = langid.subwords(texts.slice(i, 1))
        assert np.array_equal(np.sort(alone), np.sort(parts[i]))
    # " a", "ab", "b ", " c", "c " and " ab", "ab ", " c " and " ab "
    assert counts.tolist()[:4] == [9, 0, 0, 0] and len(parts[5]) == 3


def test_odd_rows_and_empty_tables(docs, odd, none):
    model = langid.learn(docs, per_language=40)
    rows = {(r["doc_id"], r["lang_pred"], r["score"], r["accepted"]) for r in langid.identify(odd, model).collect()}
    assert {r for r in rows if r[0] in (0, 1, 2, 7)} == {(i, "und", 0.0, False) for i in (0, 1, 2, 7)}
    assert langid.identify(odd, model).count() == odd.count() and langid.identify(none, model).count() == 0
    blank = langid.learn(none)
    assert {r["lang_pred"] for r in langid.identify(odd, blank).collect()} == {"und"}
    single = langid.learn(odd.where("lang = 'en'"))
    assert {r["lang_pred"] for r in langid.identify(odd, single).collect()} == {"en", "und"}


def test_fit_is_the_same_again(docs):
    one, two = langid.learn(docs, per_language=20), langid.learn(docs, per_language=20)
    assert np.array_equal(one.vectors, two.vectors) and one.least == two.least


def test_copies_do_not_thin_out_the_sample(spark, monkeypatch):
    """Languages of one text in very many copies are drawn and trained on, whatever the texts' hashes."""
    rows = [(None, f"text of language {chr(97 + i)}", f"l{i:02d}") for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").crossJoin(spark.range(200).select())
    monkeypatch.setattr(langid, "fit", lambda *sample: sample)
    _, _, truth, aside, languages = langid.learn(df, per_language=20)
    assert len(languages) == 24 and truth.tolist() == list(range(24)) and not aside.any()


def test_scores_are_plain_means_and_sums(docs):
    """Each text on its own: the mean of its n-grams' vectors, one product per language, a softmax."""
    model = langid.learn(docs, per_language=60)
    rows = docs.select("doc_id", "text").limit(60).collect()
    want = {}
    for r in rows:
        bucket, _ = langid.subwords(pa.array([r["text"]]))
        hidden = [sum(float(model.vectors[b][d]) for b in bucket) / len(bucket) for d in range(model.vectors.shape[1])]
        logits = [sum(h * w for h, w in zip(hidden, column)) + b for column, b in zip(model.weights.T.tolist(), model.bias.tolist())]
        odds = [np.exp(x / model.temperature) for x in logits]
        best = int(np.argmax(odds))
        want[r["doc_id"]] = (model.languages[best], odds[best] / sum(odds))
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()}
    assert all(found[d][0] == lang and abs(found[d][1] - score) < 1e-6 for d, (lang, score) in want.items())


def test_dirty_labels_are_bounded(spark, monkeypatch):
    rows = [(i, f"some words of text {i}", f"x{i}") for i in range(40)] + [(100 + i, f"die Wörter {i} und", "de") for i in range(9)] + [(200 + i, f"the words {i} and", "en") for i in range(9)]
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
