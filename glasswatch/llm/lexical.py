"""Ranked lexical search by pipelined term partitioning.

The terms of all items are dealt to OWNERS owners by the share of documents that hold them, rarest first, and the index holds
one part per owner: for each term the documents and its integer contribution there.  Documents are dealt to blocks of about
BLOCK.  A bundle, one item in one block, carries the scores of documents met so far (a sparse accumulator) from owner to owner;
at each the bundles of a block are cogrouped with that owner's postings of the block, which they add.

A contribution is below ``weight * TOP``, so after each owner a bundle knows what the rest can add at most.  A document that
even so stays below the block's tenth score is let go; this loses none of the ten best, equal scores included, and is why rare terms come
first.  Only what is left after the last owner is brought together to select from.

A group is bounded by BLOCK documents and ITEMS items, so neither a frequent term nor a hot source makes a large one.  Terms travel as
strings until they have numbers, so unlike terms never meet.  The items' terms join the postings by Spark's own choice, which checks their size.

Null and empty texts have no term and are never ranked; items without a term of any document yield no row.  Repeated rows are
documents, or items, of their own, with ranks of their own.  A null id comes last among equal scores, then the order is arbitrary but unique.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glasswatch.llm.common import query, shared_folder, small, table, written

BLOCK, ITEMS, TOP_K = 2048, 256, 10
# A term held by more than so many of the documents goes to the next owner.
SHARES = (0.001, 0.01, 0.1)
OWNERS = len(SHARES) + 1
# The integers of the score: scale of a term's saturation, its weight against length, and the part of length that counts.
SCALE, TF, LENGTH, SLOPE = 1_000_000_000, 1000, 8, 90
TOP = SCALE // TF
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")  # the same over UTF-8
_LONG = 1 << 20
_ROWS = 1 << 16


def _counts(text: bytes) -> Counter:
    """Terms of a text and how often each occurs; a long text's terms are never held all at once."""
    text = text.lower()  # of bytes: A-Z only
    return Counter(_TERM.findall(text) if len(text) < _LONG else (m[0] for m in _TERM.finditer(text)))


def occurrences(texts: DataFrame) -> DataFrame:
    """From (row, id, text): one row per text and distinct term: row, id, n (terms with repeats), term, tf."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2):
            at, n, term, tf = [], [], [], []

            def made():
                places = pa.array(at, pa.int64())
                columns = [batch.column(0).take(places), batch.column(1).take(places), pa.array(n, pa.int64()),
                           pa.array(term, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64())]
                for held in (at, n, term, tf):
                    held.clear()
                return pa.RecordBatch.from_arrays(columns, ["row", "id", "n", "term", "tf"])

            for place, text in enumerate(batch.column(2).cast(pa.large_binary())):
                found = _counts(text.as_py() or b"")
                at += [place] * len(found)
                n += [found.total()] * len(found)
                term += found.keys()
                tf += found.values()
                if len(at) >= _ROWS:
                    yield made()
            yield made()

    id_type = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(count, f"row long, id {id_type}, n long, term string, tf long")


def _numbered(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def _add(owner: int, k: int):
    """The work of one owner on one group: its postings go into the accumulators of the group's bundles."""
    def add(bundles: pa.Table, postings: pa.Table) -> pa.Table:
        if not len(bundles):
            return bundles
        term, row, gain = (postings[c].to_numpy() for c in ("term", "row", "gain"))
        order = np.argsort(term, kind="stable")
        term, row, gain = term[order], row[order], gain[order]
        lists = {c: bundles[c].to_pylist() for c in ("terms", "weights", "owners", "rows", "scores")}
        held = np.array([r for x in lists["rows"] for r in x], np.int64)
        rows = np.unique(np.concatenate([row, held]))
        place = np.searchsorted(rows, row)
        out_rows, out_scores = [], []
        for terms, weights, owners, old, scores in zip(*lists.values()):
            total = np.zeros(len(rows), np.int64)
            total[np.searchsorted(rows, np.array(old, np.int64))] = scores
            mine = np.array([t for t, o in zip(terms, owners) if o == owner], np.int64)
            for a, b in zip(np.searchsorted(term, mine).tolist(), np.searchsorted(term, mine, "right").tolist()):
                total[place[a:b]] += gain[a:b]  # a document once for each term
            rest = TOP * sum(w for w, o in zip(weights, owners) if o > owner)
            least = np.partition(total, -k)[-k] if len(total) >= k else 0
            kept = np.flatnonzero((total > 0) & (total + rest >= least))
            out_rows.append(rows[kept])
            out_scores.append(total[kept])
        as_lists = lambda x: pa.array(x, pa.list_(pa.int64()))
        at = bundles.schema.get_field_index
        bundles = bundles.set_column(at("rows"), "rows", as_lists(out_rows))
        return bundles.set_column(at("scores"), "scores", as_lists(out_scores))
    return add


def _weight(df: Column, n_docs: int) -> Column:
    return F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * df + 1))).cast("long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP_K, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
           item_text_col: str = "text", block: int = BLOCK, block_items: int = ITEMS) -> DataFrame:
    """The ``k`` best documents of each item with a score above 0: item, rank from 1, document, score."""
    # Numbers of rows and of terms are written with what they number: a second evaluation could deal them anew.
    wanted = written(occurrences(_numbered(items, item_col, item_text_col)).select(F.col("row").alias("item"), "id", "term"))
    met = written(occurrences(_numbered(docs, id_col, text_col)).join(wanted.select("term").distinct(), "term"))
    n = F.regexp_count(F.col(text_col).cast("string"), F.lit(TERM)).cast("long")
    size = docs.select(n.alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = size["docs"], size["terms"] or 1
    blocks = max(1, -(-n_docs // block))
    packs = max(1, -(-wanted.select("item").distinct().count() // block_items))

    share = F.col("df") / F.lit(float(max(n_docs, 1)))
    owner = sum((F.when(share > s, 1).otherwise(0) for s in SHARES), F.lit(0)).cast("int")
    terms = written(met.groupBy("term").agg(F.count("*").alias("df"))
                    .select("term", F.monotonically_increasing_id().alias("number"), _weight(F.col("df"), n_docs).alias("weight"), owner.alias("owner"))
                    .where("weight > 0"))
    asked = written(wanted.join(terms, "term")
                    .select(F.pmod(F.xxhash64("item"), F.lit(packs)).cast("int").alias("pack"), "item", "number", "weight", "owner"))

    length = F.expr(f"{100 - SLOPE} + ({SLOPE}L * n * {n_docs}L) div {n_terms}L")
    gain = met.join(terms, "term").withColumn("length", length) \
        .select("owner", "number", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), "row",
                (F.col("weight") * F.expr(f"({SCALE}L * tf) div ({TF}L * tf + {LENGTH}L * length)")).alias("gain"))
    index = _by_owner(gain.join(asked.select("number", "pack").distinct(), "number").withColumnRenamed("number", "term"))

    none = F.array().cast("array<long>")
    bundles = asked.groupBy("pack", "item").agg(F.collect_list(F.struct("number", "weight", "owner")).alias("t")) \
        .select("pack", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "item", F.col("t.number").alias("terms"),
                F.col("t.weight").alias("weights"), F.col("t.owner").alias("owners"), none.alias("rows"), none.alias("scores"))
    schema = "pack int, block int, item long, terms array<long>, weights array<long>, owners array<int>, rows array<long>, scores array<long>"
    for stage in range(OWNERS):
        postings = index.where(F.col("owner") == stage).drop("owner")
        bundles = written(bundles.groupBy("pack", "block").cogroup(postings.groupBy("pack", "block")).applyInArrow(_add(stage, k), schema))

    found = bundles.select("item", F.explode(F.arrays_zip("rows", "scores")).alias("x")) \
        .select("item", F.col("x.rows").alias("row"), F.col("x.scores").alias("score"))
    named = found.join(met.groupBy("row").agg(F.first("id").alias("doc")), "row")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"), "row")
    ranked = named.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ids = wanted.groupBy("item").agg(F.first("id").alias("id"))
    return ranked.join(ids, "item").select(F.col("id").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def _by_owner(postings: DataFrame) -> DataFrame:
    """The index: one folder of postings per owner."""
    path = shared_folder(postings.sparkSession)
    postings.write.partitionBy("owner").parquet(path)
    return postings.sparkSession.read.schema(postings.schema).parquet(path)


_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
held AS (SELECT r, doc_id, len(t)::BIGINT AS n, t FROM d WHERE len(t) > 0),
size AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM held),
tfs AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM held) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w FROM dfs, size),
asked AS (SELECT DISTINCT i, item_id, unnest(t) AS term FROM (
    SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark)),
scored AS (SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l))))::BIGINT AS score
           FROM asked JOIN w USING (term) JOIN tfs USING (term), size GROUP BY i, item_id, r, doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM best WHERE rank <= 10
"""


@query("op11_ranked_search", _SQL)
def op11(spark, sf):
    """The ten best documents of each benchmark item."""
    return search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
