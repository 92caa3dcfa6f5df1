import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from strataloom.plans import catalog

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())


def test_imports_without_the_training_data_part(tmp_path):
    """The rest works when that subpackage and the pipeline are gone."""
    code = "import sys; sys.modules['strataloom.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 50 and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.skipif(not (ROOT / "strataloom" / "llm" / "queries.py").exists(), reason="the training-data part is left out")
def test_a_missing_library_is_not_taken_for_a_part_left_out():
    code = "import sys; sys.modules['zstandard'] = None\ntry:\n    import __spark_entry__\nexcept ImportError as e:\n    assert e.name == 'zstandard'\nelse:\n    raise SystemExit('forgiven')"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["flagship", "exact_dedup", "pii_totals", "pack_blocks", "sft_pairs", "run_upsert", "corpus_build", "corpus_build_counters", "corpus_manifest", "normalize_nfkc", "head_sample", "sft_split", "bpe_train_small", "tokenizer_eval_small", "index_document", "stream_manifest", "html_blocks", "html_clean", "language_id", "quality_figures", "benchmark_spans", "decontaminated"])
def test_query_gives_what_its_sql_gives(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = catalog.QUERIES[name](spark, str(DATA))
    rel = con.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = sorted((tuple(str(r[i]) for i in order) for r in rel.fetchall()))
    assert sorted(tuple(str(r[c]) for c in sorted(got.columns)) for r in got.collect()) == want
