import random
import tracemalloc
import types

import pyarrow as pa
from pyspark.sql import functions as F

from glasswatch.llm import decontaminate as D

from .helpers import LARGER, edge_docs, rows


def distance_to_part(pattern, text):
    """Least edit distance of the pattern to a part of the text, and the first end of such a part."""
    row, best = list(range(len(pattern) + 1)), (len(pattern), 0)
    for k, c in enumerate(text, 1):
        new = [0]
        for j, p in enumerate(pattern):
            new.append(min(row[j] + (p != c), row[j + 1] + 1, new[j] + 1))
        row, best = new, min(best, (new[-1], k))
    return best


def test_search_against_brute_force():
    rng = random.Random(1)
    some = lambda n: bytes(rng.choice(b"abc ") for _ in range(n))
    for _ in range(300):
        item = some(rng.randint(5, 40))
        part = bytearray(item)
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(part) + 1)
            part[k:k + rng.randint(0, 1)] = rng.choice([b"", b"x", b"y"])
        text = some(60) + bytes(part) + some(60)
        budget = int(0.1 * len(item))
        got, want = D.Items([(1, item)], 0.1).search(text), distance_to_part(item, text)
        assert bool(got) == (want[0] <= budget)
        if got:
            assert (got[0][0], got[0][2]) == want and distance_to_part(item, text[got[0][1]:got[0][2]])[0] == want[0]


def test_normal_form():
    assert D.normal_texts(["", "  Éa,,B ", None, "!!", "x-1"]) == [b"", "éa b".encode(), b"", b"", b"x 1"]


def test_query(spark):
    from glasswatch.llm.registry import QUERIES
    docs, items = rows("documents", LARGER), rows("benchmark", LARGER)
    norm = dict(zip([x["doc_id"] for x in docs], D.normal_texts([x["text"] for x in docs])))
    inside = {(d, i["item_id"]) for i, n in zip(items, D.normal_texts([x["text"] for x in items])) for d, t in norm.items() if n in t}
    got = {(r.doc_id, r.item_id): r for r in QUERIES["op2_decontaminate"](spark, LARGER).collect()}
    assert inside <= set(got) and len(inside) > 10
    text = {x["doc_id"]: x["text"] for x in docs}
    item = dict(zip([x["item_id"] for x in items], D.normal_texts([x["text"] for x in items])))
    for (d, i), r in got.items():
        n = D.normal_texts([text[d][r.start:r.end]])[0]
        assert (n == item[i]) == (r.distance == 0) and r.distance <= int(D.RATE * len(item[i]))


def test_edges_and_blocks(spark):
    items = spark.createDataFrame([(1, "first text of the day and not"), (2, None), (3, "??"), (3, "first text of the day and not"), (None, "word tail")], "item_id long, text string")
    docs = edge_docs(spark)
    got = sorted(str((r.doc_id, r.item_id, r.distance)) for r in D.matches(docs, items).collect())
    assert got == ["(4, None, 0)", "(None, 1, 0)", "(None, 3, 0)"]
    assert sum(len(b) for b in D.blocks(items, size=1)) == 5 and len(list(D.blocks(items, size=1))) > 2
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "2", "5", "6"]
    assert D.matches(docs.limit(0), items).collect() == [] and D.matches(docs, items.limit(0)).collect() == []
    assert D.clean(docs, items.limit(0)).count() == 7
    assert sorted(str(r.doc_id) for r in D.clean(docs, items, size=1).collect()) == ["1", "2", "2", "5", "6"]


def test_texts_are_searched_in_short_slices(spark):
    texts = pa.array(["Some words of a text, and more of them.\n" * 100] * 1500)  # 6 MB
    sent = types.SimpleNamespace(value=[(1, b"an item that no text holds")])
    hit = D.contains.__globals__["arrow_udf"]
    found = []
    try:
        D.arrow_udf = lambda kind: lambda fn: lambda column: found.append(fn)
        D.contains(F.col("text"), sent)
    finally:
        D.arrow_udf = hit
    tracemalloc.start()
    out = list(found[0](iter([texts])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(x) for x in out] == [1500] and not any(out[0].to_pylist())
    assert peak < 40 << 20  # with slices of 4 MB: 146 MB
