"""The registry loads without a JVM, Spark's jars or the optional subpackage."""
import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(code: str) -> str:
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout


def test_import_opens_no_file_of_the_spark_install():
    code = (
        "import builtins, glob, zipfile\n"
        "glob.glob = lambda *a, **k: []\n"
        "def no(*a, **k): raise AssertionError('opened an archive')\n"
        "zipfile.ZipFile = no\n"
        "import __spark_entry__ as e\n"
        "from pyspark import SparkContext\n"
        "print(len(e.queries()), SparkContext._active_spark_context)\n")
    n, ctx = _run(code).split()
    assert int(n) >= 164 and ctx == "None"


def test_optional_subpackage_may_be_absent():
    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('cartwalk.llm', 'corpus_pipeline'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q)\n"
        "print(len(q))\n")
    assert int(_run(code)) >= 164


def test_oracle_text_is_complete(spark):
    import __spark_entry__ as e
    sql = e.oracle_sql()
    assert len(sql) >= 143
    assert not any("%STOP_WORDS%" in s for s in sql.values())
    assert set(sql) <= set(e.queries())
