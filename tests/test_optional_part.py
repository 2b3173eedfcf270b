"""The rest works without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_it(tmp_path):
    shutil.copytree(f"{ROOT}/gridlore", f"{tmp_path}/gridlore", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op1_') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q); print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})
    assert out.stdout.strip() == "fine", out.stderr[-800:]


def test_entry_with_a_leftover_folder(tmp_path):
    """What is left after a deletion, a folder without modules, is no subpackage; nor is one whose needs are missing."""
    shutil.copytree(f"{ROOT}/gridlore", f"{tmp_path}/gridlore", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    os.makedirs(f"{tmp_path}/gridlore/llm/__pycache__")
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and not any(k.startswith('op1_') for k in e.queries()); print('fine')"
    for text in (None, "import a_module_that_is_missing"):
        if text:
            with open(f"{tmp_path}/gridlore/llm/queries.py", "w", encoding="utf-8") as f:
                f.write(text)
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})
        assert out.stdout.strip() == "fine", out.stderr[-800:]


def test_nothing_else_imports_it():
    for top, _, names in os.walk(f"{ROOT}/gridlore"):
        if "llm" in os.path.relpath(top, ROOT).split(os.sep):
            continue
        for n in names:
            if n.endswith(".py"):
                with open(f"{top}/{n}", encoding="utf-8") as f:
                    assert "gridlore.llm" not in f.read(), n
