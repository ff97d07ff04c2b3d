import hashlib
import re
from collections import defaultdict

import duckdb
import pytest

from eventide.llm import queries
from eventide.llm.exact_dedup import ORACLE, exact_dedup, frequent, digests

SCHEMA = "doc_id long, text string, lang string, digest string, keep_id long"


def brute(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups[hashlib.sha256(norm.encode()).hexdigest()].append((-len(text or ""), i is None, i or 0, i))
    out = []
    for digest, members in groups.items():
        keep = min(members)[3]
        out += [(m[3], keep, len(members), m[3] == keep, digest) for m in members]
    return sorted(out, key=str)


ROWS = [(1, "a b c", "en", "x", 9), (2, "abc", "en", "x", 9), (3, "a\tb\u000bc  ", None, None, None),
        (4, None, None, None, None), (5, "", "en", "x", 1), (6, " \n", "en", "x", 1),
        (7, "a b", "en", "x", 1), (8, "ab", "en", "x", 1), (None, "zz", None, None, None),
        (9, "x" * 200_000, "en", "x", 1), (10, "x" * 200_000, "en", "x", 1), (2, "abc", "en", "x", 9)]


@pytest.mark.parametrize("support", [1e-3, 0.2])
def test_against_brute_force(spark, support):
    got = exact_dedup(spark.createDataFrame(ROWS, SCHEMA).repartition(3), support=support)
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS)


def test_frequent_digests_are_verified(spark):
    rows = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i}") for i in range(300)], "doc_id long, text string")
    found = frequent(digests(rows), 0.1).collect()
    assert [(r.keep_id, r.group_size) for r in found] == [(0, 100)]


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_sql(spark, sf_dir):
    got = queries.op10_exact_dedup(spark, sf_dir).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(ORACLE).df()
    key = list(got.columns)
    assert sorted(got.astype(str).values.tolist()) == sorted(want[key].astype(str).values.tolist())
