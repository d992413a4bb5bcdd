"""The entry module names its queries without a session."""

import os
import subprocess
import sys
from pathlib import Path


def test_queries_are_named_without_spark():
    code = "import __spark_entry__ as e; assert 'fx00_height_frame' in e.queries() and e.oracle_sql().keys() <= e.queries().keys()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True)


def test_core_does_not_import_llm():
    code = "import sys; from stratafold import queries; queries.all_queries(); assert not any(m.startswith('stratafold.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True)


def test_workers_need_no_copy_of_the_package(tmp_path):
    # Workers start in a folder without the package; only the driver has it on its path.
    code = (
        f"import sys; sys.path.insert(0, {str(Path(__file__).parents[1])!r})\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').config('spark.sql.session.timeZone', 'UTC').getOrCreate()\n"
        "from stratafold import queries\n"
        "for q in ('p1_found', 'p3_found', 'p4_unified_jobs', 'x04_pavement', 'x15_jittered_points', 'a25_fingerprints', 'g06_contour_lines'):\n"
        "    assert queries.all_queries()[q](s, '/root/testdata/sf0.001').count() > 0, q\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
