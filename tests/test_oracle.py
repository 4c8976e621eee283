import pytest

from quillstream.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(name, same):
    same(catalogue.queries()[name], catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(catalogue.queries().keys() - catalogue.oracle_sql().keys()))
def test_queries_without_sql_have_rows(name, spark, sf_dir):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.queries().keys() >= entry.oracle_sql().keys()


def test_entry_without_the_optional_parts(tmp_path):
    """With both folders or one module gone the rest imports, and the pipeline is left out."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parent.parent
    code = "import __spark_entry__ as e; n = e.queries(); assert 'stats_summary' in n and 'pipeline' not in n and not any(x.startswith('op1_') for x in n); e.oracle_sql()"
    for gone in ("quillstream/llm", "quillstream/llm/common.py"):
        copy = tmp_path / gone.replace("/", "-")
        for x in ("quillstream", "__spark_entry__.py", "corpus_pipeline.py"):
            if (root / x).is_dir():
                shutil.copytree(root / x, copy / x, ignore=shutil.ignore_patterns("__pycache__"))
            elif (root / x).exists():
                copy.mkdir(exist_ok=True)
                shutil.copy(root / x, copy / x)
        target = copy / gone
        if target.is_dir():
            shutil.rmtree(target)
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        else:
            target.unlink(missing_ok=True)
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})
