import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_works_without_the_text_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'words' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
    some = "page_model or cell_text or lines_blocks or reader_relations or commands or (against_sql and pdf_words)"
    run = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "-x", "-k", f"({some}) and not without", "-p", "no:cacheprovider"], cwd=copy, timeout=600, capture_output=True, text=True)
    assert run.returncode == 0, run.stdout[-2000:]
