"""The entry point without the training-data folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import json, __spark_entry__ as e; print('SHOW', json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def names(folder):
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    import json

    return json.loads(out.stdout.rpartition("SHOW ")[2])


def copied(to, *left_out):
    shutil.copytree(ROOT, to, ignore=lambda d, found: [x for x in found if x in (".git", "__pycache__") or os.path.relpath(os.path.join(d, x), ROOT) in left_out])
    return to


def test_without_training_data_folders(tmp_path):
    from wayfare import catalog

    for i, left_out in enumerate([("wayfare/llm", "tests/llm"), ("wayfare/llm", "tests/llm", "corpus_pipeline.py")]):
        queries, oracles = names(copied(tmp_path / str(i), *left_out))
        assert queries == sorted(catalog.QUERIES) and oracles == sorted(catalog.ORACLE_SQL)


def test_a_broken_operator_is_not_hidden(tmp_path):
    """Only a missing folder is passed over; a module that is there and fails to import raises."""
    if not os.path.isdir(os.path.join(ROOT, "wayfare/llm")):
        return
    where = copied(tmp_path / "broken")
    with open(where / "wayfare/llm/queries.py", "a") as f:
        f.write("\nimport a_module_that_is_not_there\n")
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=where, env={**os.environ, "PYTHONPATH": str(where)}, capture_output=True, text=True, timeout=120)
    assert out.returncode != 0 and "a_module_that_is_not_there" in out.stderr
