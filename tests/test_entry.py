"""The driver's entry points, with and without what may be taken away."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n.startswith('op') and n[2].isdigit() for n in e.queries()), 'pipeline' in e.queries())"


def asked(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", ASK], cwd=folder, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def copied(folder):
    for name in ("seamline", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, folder / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, folder / name)


def test_without_the_training_data_folders(tmp_path):
    copied(tmp_path)
    shutil.rmtree(tmp_path / "seamline" / "llm", ignore_errors=True)
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    many, with_sql, operators, pipeline = asked(tmp_path)
    assert int(many) > 150 and int(with_sql) > 150 and (operators, pipeline) == ("0", "False")


def test_with_a_module_that_cannot_be_imported(tmp_path):
    copied(tmp_path)
    shutil.rmtree(tmp_path / "seamline" / "llm", ignore_errors=True)
    (tmp_path / "seamline" / "llm").mkdir()
    (tmp_path / "seamline" / "llm" / "__init__.py").write_text("")
    (tmp_path / "seamline" / "llm" / "catalog.py").write_text("import nothing_of_this_name\n")
    (tmp_path / "corpus_pipeline.py").write_text("import nothing_of_this_name\n")
    many, _, operators, pipeline = asked(tmp_path)
    assert int(many) > 150 and (operators, pipeline) == ("0", "False")


def test_sql_belongs_to_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
