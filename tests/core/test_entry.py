import sys

import __spark_entry__ as entry


def test_entry_and_registries(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_the_training_data_operators(tmp_path):
    """A copy of the repository without those folders still imports and lists the other queries."""
    import shutil
    import subprocess
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = list(e.queries()); assert n and not any(x.startswith('op') or x == 'pipeline' for x in n), n"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
