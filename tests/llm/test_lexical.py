import collections
import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from glasswatch.llm import lexical

from .helpers import LARGER, LOWER, SMALL, edge_docs, rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k=10):
    """Per item all (score, id) of the k best, by the formula alone."""
    terms = lambda text: TERM.findall((text or "").translate(LOWER))
    met = [(i, collections.Counter(terms(t))) for i, t in docs]
    met = [(i, c) for i, c in met if c]
    df = collections.Counter(t for _, c in met for t in c)
    big_n, big_l = len(met), sum(c.total() for _, c in met)
    out = []
    for item, text in items:
        found = []
        for i, c in met:
            m = 10 + 90 * c.total() * big_n // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return out


def shown(found):
    return sorted(tuple(-1 if v is None else v for v in r) for r in found)


@pytest.mark.parametrize("folder", [SMALL, LARGER])
def test_query(spark, folder):
    from glasswatch.llm.registry import QUERIES, SQL
    got = QUERIES["op11_ranked_search"](spark, folder).select("item_id", "rank", "doc_id", "score").collect()
    want = brute([(x["doc_id"], x["text"]) for x in rows("documents", folder)], [(x["item_id"], x["text"]) for x in rows("benchmark", folder)])
    assert shown(got) == shown(want) and want
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    assert shown(db.sql(SQL["op11_ranked_search"]).fetchall()) == shown(want)


@pytest.mark.parametrize("block, pack, k", [(2048, 256, 10), (7, 3, 10), (1, 1, 2), (40, 2, 1000)])
def test_blocks_and_packs_change_nothing(spark, block, pack, k):
    docs, items = rows("documents")[:150], rows("benchmark")[:12]
    # A copied group, so that equal scores reach over the tenth place, and an item that is a document's own beginning.
    docs += [{"doc_id": 5000 - i, "text": docs[3]["text"]} for i in range(25)]
    items += [{"item_id": 900, "text": docs[3]["text"][:80]}, {"item_id": 901, "text": "wordthatisnowhere"}, {"item_id": 902, "text": None}]
    frame = lambda x, c: spark.createDataFrame([(r[c], r["text"]) for r in x], f"{c} long, text string")
    got = lexical.search(frame(docs, "doc_id"), frame(items, "item_id"), k, block=block, block_items=pack).collect()
    assert shown(got) == shown(brute([(r["doc_id"], r["text"]) for r in docs], [(r["item_id"], r["text"]) for r in items], k))


def test_edges(spark):
    items = spark.createDataFrame([(1, "The first TEXT", "x"), (1, "The first TEXT", "y"), (2, None, "z"), (3, "", "z"), (None, "word tail", "z")],
                                  "item_id long, text string, doc_id string")
    docs = edge_docs(spark)
    many = docs.unionByName(docs.withColumn("text", F.lit("first of them"))).unionByName(docs.withColumn("text", F.lit("nothing else")))
    want = brute([(r.doc_id, r.text) for r in many.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert shown(lexical.search(many, items).collect()) == shown(want) and want
    assert lexical.search(edge_docs(spark, True), items).count() == 0
    assert lexical.search(docs, items.where("false")).count() == 0


def test_long_texts_count_alike():
    text = ("Some Words, äß and_more 12 " * 50_000).encode()
    want = collections.Counter(TERM.findall(text.decode().translate(LOWER)))
    assert len(text) > lexical._LONG and lexical._counts(text) == {t.encode(): n for t, n in want.items()}
