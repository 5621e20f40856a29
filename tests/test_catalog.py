import duckdb
import pytest

from pairwell.catalog import REGISTRY
from pairwell.catalog.base import TABLES, Tables

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "clean_headers_tokens_and_texts", "normalize_dates", "parse_run_names", "complete_recording_sets", "first_recording",
    "persons_with_counterpart", "crosstab_with_margins", "weighted_auroc", "weighted_auroc_by_language", "grouped_folds",
    "greedy_matching", "nearest_age_pairs", "strata_weights", "fisher_exact_by_site", "fixed_length_chunks",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def canonical(rows):
    def plain(v):
        if isinstance(v, float):
            return round(v, 5) + 0.0
        return str(v) if not isinstance(v, (int, str, type(None))) else v

    return sorted(str(tuple(plain(v) for v in r)) for r in rows)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, duck, name):
    entry = REGISTRY[name]
    df = entry.run(Tables(spark, FOLDER))
    columns = sorted(df.columns)
    cursor = duck.execute(entry.sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    assert canonical([tuple(r[c] for c in columns) for r in df.collect()]) == canonical(expected)


def test_every_statement_has_a_query_and_items():
    assert all(e.covers for e in REGISTRY.values())
    assert len(REGISTRY) > 120


def test_grouped_folds_count_persons_without_recordings(spark, tmp_path):
    for name in ("customer", "orders"):
        rows = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        if name == "orders":
            rows = rows.where("o_custkey % 3 <> 0")
        rows.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    con = duckdb.connect()
    for name in ("customer", "orders"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    entry = REGISTRY["grouped_folds"]
    got = sorted(tuple(r) for r in entry.run(Tables(spark, str(tmp_path))).select("rec_no", "fold").collect())
    assert got == sorted(con.execute(f"select rec_no, fold from ({entry.sql})").fetchall())
