import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_llm_folders():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith('veilspark.llm') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert 'rule_hits' in names and not any(n.startswith('op') and n[2].isdigit() for n in names) and 'pipeline' not in names
assert e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rpartition("/")[0])


@pytest.mark.parametrize("name", ["rule_scan_email", "rule_scan_credit_card", "zero_width_runs", "term_hits", "span_islands", "export_names", "line_chunks", "hit_boxes", "file_kind", "residue_needles", "residue_everywhere", "document_residue"])
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda v: None if v is None else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    a = sorted((tuple(text(v) for v in r) for r in got.select(*want.columns).collect()), key=repr)
    b = sorted((tuple(text(v) for v in r) for r in want.fetchall()), key=repr)
    assert a == b and a


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["file_id", "rule_id", "category", "start", "end", "line", "quote"] and df.count() > 0
