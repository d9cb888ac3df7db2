"""The registry: importable without a session, and queries that match their oracles on the smallest tables."""

import math
import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
SAMPLE = ("pack_unpack_by_chunk", "pack_words_3bit", "count_in_packed_words", "find_subsequence", "axis_sums_cube", "chunk_encoding_choice", "motif_features", "ca_cyclic", "online_edits", "ew_binary")


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_all_but_the_corpus_operators_work_without_them(tmp_path):
    """A copy without the corpus operators' folders and pipeline still imports and has all other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__spark_entry__.__file__).resolve().parent
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 150 and set(o) == set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path / "copy")})
    outside = [p for p in root.glob("nibblespark/**/*.py") if "llm" not in p.parts and "nibblespark.llm" in p.read_text()]
    assert not outside


def test_entry(spark):
    if os.path.isdir(SF):
        assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    df = __spark_entry__.queries()[name](spark, SF)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    norm = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(norm(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()), key=repr)
