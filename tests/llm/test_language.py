import zlib

import pyarrow as pa

from heirflow.llm import language


def test_held_out_accuracy_and_cases(docs, rows):
    model = language.train(docs)
    found = language.identify(docs, model).collect()
    assert len(found) == len(rows)
    truth = {(r[0], r[1]): r[2] for r in rows}
    assert model.languages == ("de", "en", "es", "fr")
    assert model.pairs == (("family germanic", "family romance"), ("de", "en"), ("es", "fr"))
    by_id = {r.doc_id: r for r in found}
    hits = [by_id[i].lang_pred == lang for (i, _), lang in truth.items() if i is not None and i < 150 and i != 5]
    assert sum(hits) / len(hits) > 0.95
    for r in found:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    for i, text in ((1000, ""), (1008, "1 2 3"), (2000, None)):
        assert by_id[i].lang_pred == "und" and by_id[i].score == 0
    assert by_id[1014].lang_pred != "und"


def test_labels_of_held_out_rows_and_inputs_do_not_matter(docs):
    from pyspark.sql import functions as F

    model = language.train(docs)
    other = language.train(docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))))
    assert model.languages == other.languages and (model.weights == other.weights).all()


def test_bound_no_labels_and_empty(docs, no_docs, clashing):
    from pyspark.sql import functions as F

    assert language.training_sample(docs, 8).groupBy("lang").count().where("count > 4").count() == 0
    model = language.train(no_docs)
    assert language.identify(no_docs, model).count() == 0
    assert {r[0] for r in language.identify(docs, model).select("lang_pred").distinct().collect()} == {"und"}
    one = language.train(docs.withColumn("lang", F.lit("de")))
    assert one.predict(pa.array(["hello", None, "é", "7"]))[0] == ["de", "und", "de", "und"]
    assert language.identify(clashing, model).count() == clashing.count()


def test_rejected_rows_go(docs, rows):
    kept = language.keep_identified(docs, language.train(docs))
    assert kept.columns == docs.columns
    lettered = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    assert kept.count() == len(lettered)
    # without a label nothing is learned, and no document with a letter is dropped for that
    none = docs.withColumn("lang", docs.lang.substr(1, 0)).where("lang IS NULL").select(docs.columns)
    assert language.keep_identified(none, language.train(none.where("doc_id < 0"))).count() == sum(1 for r in lettered if r[2] is None)
