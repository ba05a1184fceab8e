"""The entry module with and without the training-text operators, the pipeline, and the libraries that these need."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; print(*sorted(e.queries()), sep=','); print(*sorted(e.oracle_sql()), sep=',')"


def said(tmp_path, gone=(), path=None, before=""):
    """The names of queries and SQL that a copy without some parts gives."""
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "paperproof"):
        at = ROOT / name
        if at.exists() and name not in gone:
            shutil.copytree(at, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", *(x.split("/")[1] for x in gone if "/" in x))) if at.is_dir() else shutil.copy(at, tmp_path / name)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | ({"PYTHONPATH": str(path)} if path else {})
    ran = subprocess.run([sys.executable, "-B", "-c", before + SAY], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120, check=True)
    return [x.split(",") for x in ran.stdout.strip().split("\n")]


@pytest.mark.parametrize("path", [None, ROOT])
@pytest.mark.parametrize("gone", [(), ("corpus_pipeline.py",), ("paperproof/llm",), ("paperproof/llm", "corpus_pipeline.py")])
def test_queries_without_parts(tmp_path, gone, path):
    from paperproof.oracle import ORACLE
    from paperproof.queries import QUERIES

    names, oracles = said(tmp_path, gone, path)
    assert set(QUERIES) <= set(names) and set(ORACLE) <= set(oracles)
    whole = (ROOT / "paperproof/llm").exists() and "paperproof/llm" not in gone
    assert any(x.startswith("op1_") for x in names) == whole
    assert ("pipeline" in names) == (whole and (ROOT / "corpus_pipeline.py").exists() and "corpus_pipeline.py" not in gone)


@pytest.mark.parametrize("library", ["zstandard", "xxhash", "ahocorasick"])
def test_queries_without_a_library(tmp_path, library):
    from paperproof.oracle import ORACLE
    from paperproof.queries import QUERIES

    names, oracles = said(tmp_path, before=f"import sys; sys.modules['{library}'] = None; ")
    assert set(QUERIES) <= set(names) and set(ORACLE) <= set(oracles)


def test_one_place_to_import_from():
    import paperproof

    assert sorted(paperproof.__all__) == sorted({*paperproof.__all__}) and all(hasattr(paperproof, n) for n in paperproof.__all__)
