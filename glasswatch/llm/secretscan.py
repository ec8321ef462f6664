"""Secret scan with DataFrame functions only.

Base rules find assignments to secret names, access keys and hexadecimal runs.  A pair of first-order Markov models of
characters, one of random strings and one of ordinary identifiers, judges every other long token: their log-likelihood
ratio plus the prior log-odds must be positive.  Both are trained from labelled strings: random ones made from digests,
ordinary ones from words of a bounded sample of documents (SAMPLE_DOCS, those with the smallest hash of their id), alone
and joined as identifiers are, decimal numbers, and runs of one character.  The models are a table of 68 x 68 ratios whatever the input.

Places count code points, ends exclusive.  They are prefix sums over the pieces that a pattern splits a text into, in
blocks, so many matches in one text cost no square.  Null and empty texts have no spans.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glasswatch.llm.common import query, table

# Base rules, fixed values: kind, pattern, group whose length counts, least length.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
MODEL = "model"
LONG = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SIZE = len(ALPHABET) + 1  # 0 is any other character
SAMPLE_DOCS = 200
RANDOM_STRINGS = 1_000
# Of the long tokens of ordinary text, about one in a thousand is a secret.
PRIOR = math.log(1 / 1000)
BLOCK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def sums_before(values: Column) -> Column:
    """For each of an array's numbers the sum of those before it, block by block."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")),
                      lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))

    def inside(blocks: Column) -> Column:
        heads = let(F.transform(blocks, total), lambda s: F.transform(s, lambda _, i: total(F.slice(s, F.lit(1), i))))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), heads.alias("h")), lambda z: F.transform(
            z["b"], lambda _, j: z["h"] + total(F.slice(z["b"], F.lit(1), j)))))
    return let(cut, inside)


def _struct(rank: int, kind: str, start: Column, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), F.lit(rank).alias("rank"), end.cast("long").alias("end"), F.lit(kind).alias("kind"))


NONE = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def places(text: Column, pattern: str, group: int, least: int, rank: int, kind: str) -> Column:
    """Spans of the leftmost non-overlapping matches whose group has at least ``least`` characters."""
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p).cast("long"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(gaps: Column, found: Column, parts: Column) -> Column:
        n = F.size(found)
        sizes = F.transform(found, lambda m: F.char_length(m).cast("long"))
        # A match starts after all gaps up to its own and all matches before it.
        steps = F.zip_with(F.slice(gaps, F.lit(1), n), sizes, lambda g, m: g + m)
        zipped = F.arrays_zip(sums_before(steps).alias("at"), F.slice(gaps, F.lit(1), n).alias("gap"), found.alias("m"), parts.alias("part"))
        good = F.filter(zipped, lambda z: F.char_length(z["part"]) >= least)
        return F.transform(good, lambda z: _struct(rank, kind, z["at"] + z["gap"], z["at"] + z["gap"] + F.char_length(z["m"])))

    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    all_spans = let(gaps, lambda g: let(found, lambda f: let(parts, lambda p: spans(g, f, p)) if group else spans(g, f, f)))
    return F.when(text.rlike(pattern), all_spans).otherwise(F.array().cast(NONE))


def samples(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            documents: int = SAMPLE_DOCS, strings: int = RANDOM_STRINGS) -> DataFrame:
    """Labelled strings: (random boolean, string).  Ordinary ones come from ``documents`` texts at most."""
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")).cast("binary"), 256)
    coded = F.base64(F.unhex(digest))
    plain = F.regexp_replace(coded, "[^A-Za-z0-9]", "")
    made = spark.range(strings).select(F.explode(F.array(digest, coded, plain, F.upper(plain), F.upper(digest))).alias("string"))
    number = spark.range(5 * strings).select(F.conv(F.substring(digest, 1, 14), 16, 10).alias("string"))
    some = docs.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("t")) \
        .orderBy("h", "t").limit(documents)
    word = F.filter(F.split(F.coalesce("t", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w.rlike("^[A-Za-z]{3,}$"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.get("w", i - 1).alias("a"), F.get("w", i).alias("b")))
    joined = F.flatten(F.transform("p", lambda p: F.array(
        F.concat(p["a"], F.lit("_"), p["b"]), F.concat(p["a"], F.lit("-"), p["b"]), F.concat(p["a"], F.lit("/"), p["b"]),
        F.concat(F.lower(p["a"]), F.initcap(p["b"])), F.concat(F.lower(p["a"]), F.lower(p["b"])), F.upper(F.concat(p["a"], F.lit("_"), p["b"])))))
    words = some.select(word.alias("w")).where(F.size("w") > 1).select(pairs.alias("p")).select(F.explode(joined).alias("string"))
    runs = spark.range(strings // 100).select(F.explode(F.array(*(F.repeat(F.lit(c), 200) for c in ALPHABET))).alias("string"))
    return made.select(F.lit(True).alias("random"), "string").unionByName(
        words.unionByName(number).unionByName(runs).select(F.lit(False).alias("random"), "string"))


def _codes(string: Column) -> Column:
    """Numbers of the character pairs of a string."""
    def pairs(chars: Column) -> Column:
        return F.zip_with(F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars) - 1),
                          lambda a, b: a * SIZE + b)
    numbers = F.transform(F.filter(F.split(string, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(ALPHABET)))
    return let(numbers, pairs)


def fit(labelled: DataFrame) -> list[float]:
    """log P(second | first, random) - log P(second | first, ordinary) of each pair; at most 2 x SIZE**2 rows are read."""
    seen = labelled.where(F.char_length("string") > 1).select("random", F.explode(_codes(F.col("string"))).alias("code")) \
        .groupBy("random", "code").count().collect()
    counts = {True: [0.0] * SIZE**2, False: [0.0] * SIZE**2}
    for x in seen:
        counts[x["random"]][x["code"]] += x["count"]

    def logs(c: list[float]) -> list[float]:
        rows = [sum(c[a * SIZE:(a + 1) * SIZE]) for a in range(SIZE)]
        return [math.log((c[k] + 0.5) / (rows[k // SIZE] + 0.5 * SIZE)) for k in range(SIZE**2)]
    return [round(r - o, 4) for r, o in zip(logs(counts[True]), logs(counts[False]))]


def ratio(string: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of random against ordinary."""
    # One string constant, parsed once when the plan is made: thousands of literals would be a large plan.
    numbers = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    return F.aggregate(_codes(string), F.lit(0.0), lambda a, c: a + F.get(numbers, c))


def find(text: Column, model: list[float], prior: float = PRIOR) -> tuple[Column, Column]:
    """Base spans and all spans of a text, as sorted arrays of (start, rank, end, kind)."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    base = F.array_sort(F.concat(*(places(text, p, g, least, r, k) for r, (k, p, g, least) in enumerate(KINDS))))
    return base, F.filter(places(text, LONG, 0, 20, len(KINDS), MODEL), lambda s: F.coalesce(
        ratio(F.substring(text, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")), model) + prior > 0, F.lit(False)))


def scan(docs: DataFrame, model: list[float], text_col: str = "text", into: str = "spans", base_into: str = "base_spans") -> DataFrame:
    """The rows with two more columns: base spans, and all spans.  Columns of these names are replaced."""
    base, more = find(F.col(text_col), model)
    return docs.withColumn(base_into, base).withColumn(into, F.array_sort(F.concat(F.col(base_into), F.filter(
        more, lambda s: ~F.exists(F.col(base_into), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask(text: Column, spans: Column, tag: str = "[SECRET]") -> Column:
    """The text with each maximal run of overlapping spans replaced by a tag."""
    start = F.struct(F.lit(0).cast("long").alias("done"), F.array().cast("array<string>").alias("out"))
    # Pieces are as many as spans; joined once at the end.
    folded = F.aggregate(spans, start, lambda a, s: F.struct(
        F.greatest(a["done"], s["end"]).alias("done"),
        F.when(s["start"] >= a["done"], F.concat(a["out"], F.array(
            F.substring(text, a["done"].cast("int") + 1, (s["start"] - a["done"]).cast("int")), F.lit(tag)))).otherwise(a["out"]).alias("out")))
    masked = let(folded, lambda f: F.concat(F.array_join(f["out"], ""), F.substring(text, f["done"].cast("int") + 1, F.lit(2**31 - 1))))
    return F.when(F.size(spans) > 0, masked).otherwise(text)


def trained(spark: SparkSession, docs: DataFrame) -> list[float]:
    return fit(samples(spark, docs))


@query("op8_secret_scan")
def op8(spark, sf):
    """Spans in all documents; no SQL twin (trained models)."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = scan(docs, trained(spark, docs))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k, *_ in KINDS),
                        F.sha2(digest(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
