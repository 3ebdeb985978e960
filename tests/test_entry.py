"""The driver's contract, with and without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_subpackage():
    for path in ROOT.glob("gridloom/**/*.py"):
        if "llm" not in path.parts:
            assert "gridloom.llm" not in path.read_text() and "from .llm" not in path.read_text()


def test_entry_imports_without_the_subpackage(tmp_path):
    for part in ("__spark_entry__.py", "gridloom"):
        subprocess.run(["cp", "-r", str(ROOT / part), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "gridloom" / "llm")], check=True)
    code = "import __spark_entry__ as e; assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries()); print(len(e.queries()))"
    made = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert made.returncode == 0, made.stderr


def test_entry_imports_without_an_optional_library(tmp_path):
    for name in ("ahocorasick", "zstandard", "public_tokenizers"):
        (tmp_path / f"{name}.py").write_text(f"raise ModuleNotFoundError('no module named {name}', name='{name}')")
    code = "import __spark_entry__ as e; assert 'tpch_q1' in e.queries() and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    made = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:{ROOT}"}, capture_output=True, text=True)
    assert made.returncode == 0, made.stderr
