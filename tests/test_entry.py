"""The driver's contract, also without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__
from tests.conftest import ROOT


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_imports_without_llm(tmp_path):
    for name in ("turnweave", "__spark_entry__.py"):
        source, target = os.path.join(ROOT, name), tmp_path / name
        shutil.copytree(source, target, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, target)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'match' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(os.path.join(ROOT, "turnweave")):
        if os.sep + "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "turnweave.llm" not in open(os.path.join(folder, n)).read()
