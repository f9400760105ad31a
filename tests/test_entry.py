"""The driver contract, with and without the corpus operators."""

import subprocess
import sys
import textwrap

import __spark_entry__


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_corpus_operators():
    code = """
        import sys
        class Block:
            def find_spec(self, name, path=None, target=None):
                if name in ("corpus_pipeline",) or name.startswith("lithic.llm"):
                    raise ModuleNotFoundError(name, name=name)
        sys.meta_path.insert(0, Block())
        import __spark_entry__ as e
        assert e.llm_queries is None and e.corpus_pipeline is None
        assert len(e.queries()) > 50 and not any(n.startswith("op") and n[2].isdigit() for n in e.queries())
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, cwd=__spark_entry__.__file__.rpartition("/")[0])
