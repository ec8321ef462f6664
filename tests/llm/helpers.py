"""What the tests of the subpackage share: tables, rows with every edge case, words by regular expression."""

import re

import pyarrow.dataset as ds

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
# Null and empty texts, repeated rows, a null id, and columns whose names the operators use themselves.
EDGE_SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, id string, fp string, spans string, key bigint, "
               "label string, bytes string, __m int, __doc int, __votes int")


def rows(table, folder=SMALL, columns=None):
    return ds.dataset(f"{folder}/{table}.parquet").to_table(columns=columns).to_pylist()


def edge_docs(spark, empty=False):
    rest = ["x"] * 3 + [1] + ["y"] * 2 + [1, 2, 3]
    some = [(1, None, None, None, None, *rest), (2, "", "en", "s", 0, *rest), (2, "", "en", "s", 0, *rest),
            (None, "The first text of the day, and not a long one at all.", "en", "s", 53, *rest),
            (4, "word " * 30_000 + "tail", None, "s", None, *rest), (5, " \t\n", "fr", "s", 3, *rest), (6, "12 34 !?", "en", "s", 8, *rest)]
    return spark.createDataFrame([] if empty else some, EDGE_SCHEMA)
