import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def names(folder):
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=folder, capture_output=True, text=True)
    return done.returncode, done.stdout.split(), done.stderr


def test_library_without_training_operators(tmp_path):
    shutil.copytree(ROOT / "taskframe", tmp_path / "taskframe")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.rmtree(tmp_path / "taskframe/llm", ignore_errors=True)
    code, found, err = names(tmp_path)
    assert code == 0 and "status_reply" in found and not any(n.startswith("op") and n[2].isdigit() for n in found), err


def test_other_import_errors_show(tmp_path):
    shutil.copytree(ROOT / "taskframe", tmp_path / "taskframe")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module_at_all\n")
    code, _, err = names(tmp_path)
    assert code and "no_such_module_at_all" in err
