import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_a_session_and_without_the_subpackage(tmp_path):
    """Names are there before any session; without ``tidemark.llm`` and the pipeline the rest still loads."""
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n[:2] == 'op' and n[2:3].isdigit() or n == 'pipeline' for n in q))"
    whole = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    block = "import sys, importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        if name.startswith('tidemark.llm') or name == 'corpus_pipeline':\n            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, Gone())\n"
    rest = subprocess.run([sys.executable, "-c", block + code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert rest[1] == "0" and int(rest[0]) > 100 and int(rest[0]) + int(whole[1]) == int(whole[0])


def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "ctx_events" in df.columns
