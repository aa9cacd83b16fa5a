import subprocess
import sys

import __spark_entry__


def test_flagship(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 91 and rows[0].asDict().keys() == {"month", "revenue", "n_jobs"}


def test_queries_and_sql_go_together():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_operators():
    """With the subpackage out of reach the other queries are still there."""
    code = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("weftline.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
names = set(e.queries())
assert len(names) > 100 and not any(n.startswith("op") or n == "pipeline" for n in names)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__spark_entry__.__file__.rpartition("/")[0])
