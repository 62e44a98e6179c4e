"""The entry module, with and without the training-data subpackage."""

import os
import re
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and df.columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_training_data_operators():
    hide = "import sys, importlib.abc\nclass Hide(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        if name.startswith('duelframe.llm') or name == 'corpus_pipeline':\n            raise ModuleNotFoundError(name)\nsys.meta_path.insert(0, Hide())\n"
    out = run(hide + "import __spark_entry__ as e\nq = e.queries()\nassert 'gallery_page' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']\nprint(len(e.oracle_sql()))")
    assert out.returncode == 0, out.stderr


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "duelframe")):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as f:
                    assert not re.search(r"import.*\bllm\b|from.*\bllm\b", f.read()), n
