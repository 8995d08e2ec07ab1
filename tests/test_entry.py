import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_training_data_operators(tmp_path):
    for x in REPO.iterdir():
        if x.name not in (".git", "corpus_pipeline.py", "rillflow"):
            (tmp_path / x.name).symlink_to(x)
    (tmp_path / "rillflow").mkdir()
    for x in (REPO / "rillflow").iterdir():
        if x.name not in ("llm", "__pycache__"):
            (tmp_path / "rillflow" / x.name).symlink_to(x)
    code = "import sys; sys.path.insert(0, '.'); import importlib.util as u; s = u.spec_from_file_location('e', 'entry_copy.py'); m = u.module_from_spec(s); s.loader.exec_module(m); print(len(m.queries()), any(k.startswith('op') or k == 'pipeline' for k in m.queries()))"
    (tmp_path / "entry_copy.py").write_text((REPO / "__spark_entry__.py").read_text())
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.split()[-1:] == ["False"], done.stderr
