"""Registered queries against their SQL on the smallest tables, and the rest of the library without the corpus subpackage."""

import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from introngrid.plans import catalog

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
#: One or two queries of each family; the driver runs all of them.
NAMES = ["g03_introns", "g12_splice_blocks", "g20_junction_groups", "c01_initial_clusters", "c03_refine_links_exons", "c07_psi", "c10_clustering_summary", "q03_normalize_local", "q15_em_abundance", "q22_ec_design_grouped", "d05_plan_contrasts", "p01_bh", "p13_calibrate_exceedance", "p25_reproducibility", "r13_ari_nmi", "s04_read_matrix_market", "s13_read_wide_counts"]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "-"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = catalog.queries()[name](spark, SF)
    columns = sorted(found.columns)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in found.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_flagship_has_rows_and_shares_add_up(spark):
    rows = catalog.queries()["c11_psi_pipeline"](spark, SF)
    assert rows.count() > 0 and rows.where("psi < 0 OR psi > 1").count() == 0


def test_imports_without_the_corpus_subpackage(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".*_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 200 and set(e.oracle_sql()) < set(q), len(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)


def test_nothing_else_imports_the_corpus_subpackage():
    for path in (ROOT / "introngrid").rglob("*.py"):
        if "llm" not in path.parts:
            assert "introngrid.llm" not in path.read_text()
