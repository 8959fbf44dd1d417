"""The entry module with and without the optional text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LIST = "import sys; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; print(len(e.queries()), sorted(n for n in e.queries() if n == 'pipeline' or n[:2] == 'op' and n[2].isdigit()))"


def copy(folder: Path, *without: str) -> Path:
    skip = {ROOT / w for w in without}
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "catalog", "gridsmith"):
        source = ROOT / name
        if source in skip or not source.exists():
            continue
        if source.is_dir():
            shutil.copytree(source, folder / name, ignore=lambda d, names: [n for n in names if Path(d, n) in skip or n == "__pycache__"])
        else:
            shutil.copy(source, folder / name)
    return folder


def listed(folder: Path) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", LIST, str(folder)], capture_output=True, text=True, timeout=120, cwd=folder)


@pytest.mark.parametrize("without", [("gridsmith/llm",), ("gridsmith/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_import_without_text_operators(tmp_path, without):
    done = listed(copy(tmp_path, *without))
    assert done.returncode == 0, done.stderr
    assert ("op1_" in done.stdout) == ("gridsmith/llm" not in without and (ROOT / "gridsmith/llm").exists())
    assert "'pipeline'" not in done.stdout


def test_other_missing_imports_stay_errors(tmp_path):
    folder = copy(tmp_path)
    (folder / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert "no_such_module" in listed(folder).stderr
