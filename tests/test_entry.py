import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 80
    assert entry.entry(spark).count() >= 0


def test_without_the_optional_parts(tmp_path):
    for name in ("__spark_entry__.py", "quernstone"):
        source = os.path.join(HERE, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "quernstone" / "llm", ignore_errors=True)
    for left in (False, True):
        if left:
            (tmp_path / "quernstone" / "llm").mkdir()
        code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(x.startswith('op') for x in q) and len(q) > 80, len(q); e.oracle_sql()"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
