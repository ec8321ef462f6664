import zlib

from glasswatch.llm import langid

from .helpers import LARGER, edge_docs, rows


def test_held_out_accuracy(spark):
    from glasswatch.llm.registry import QUERIES
    got = {r.doc_id: r for r in QUERIES["op9_language_id"](spark, LARGER).collect()}
    docs = rows("documents", LARGER)
    assert len(got) == len(docs)
    held = [x for x in docs if zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0]
    assert all(got[x["doc_id"]].held_out == (x in held) for x in docs)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[x["doc_id"]].lang_pred == x["lang"] for x in held) >= 0.98 * len(held)


def test_mixture_of_two(spark):
    docs = spark.createDataFrame([(k, t, l) for k, (t, l) in enumerate(
        [("the house and the garden with the trees " * 5, "en"), ("das haus und der garten mit den bäumen " * 5, "de"), ("la maison et le jardin avec les arbres " * 5, "fr")])],
        "doc_id int, text string, lang string")
    model = langid.Model.of(langid.fit(docs))
    both = spark.createDataFrame([(1, "the house and the garden with the trees " * 6 + "das haus und der garten mit den bäumen " * 3), (2, "the garden and the house")], "doc_id int, text string")
    got = {r.doc_id: r for r in langid.predict(both, model).collect()}
    assert got[1].lang_pred == "en" and 0.5 < got[1].score < 0.85 and '"de"' in got[1].languages and '"fr"' not in got[1].languages
    assert got[2].languages == '{"en": 1.0}'


def test_edges(spark):
    docs = edge_docs(spark)
    got = langid.predict(docs, langid.Model.of(langid.fit(docs))).collect()
    assert sorted(r.lang_pred for r in got)[-5:] == ["und"] * 5 and all(r.score == 0 for r in got if r.lang_pred == "und")
    nothing = langid.Model.of(langid.fit(docs.limit(0)))
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, nothing).collect()} == {("und", 0.0)}
    assert langid.predict(docs.limit(0), nothing).collect() == []
