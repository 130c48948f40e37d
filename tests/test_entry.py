import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_problem_and_oracle_has_its_query():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert {"p2_found", "p4_found", "p5_found"} <= set(names)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 37


def test_the_rest_stands_without_llm(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; n = e.queries(); assert 'p5_found' in n and 'p1_found' not in n and set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120)


def test_intermediate_tables_go_to_the_shared_folder_and_away(spark):
    from quirefold.runtime import materialize, release_scratch, shared_dir, spread

    df = materialize(spark.range(5), "t")
    path = df.inputFiles()[0]
    assert path.removeprefix("file:").lstrip("/").startswith(shared_dir(spark).removeprefix("file:").lstrip("/"))
    assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(df, 0) is df
    release_scratch()
    assert not Path("/" + path.removeprefix("file:").lstrip("/")).exists()
