import importlib
import importlib.util
import subprocess
import sys

import __spark_entry__ as entry


def test_contract(spark):
    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found) and len(found) >= 40
    rows = entry.entry(spark)
    assert rows.columns == ["id", "final", "passage"] and rows.count() == 200


def test_works_without_the_optional_operators(monkeypatch):
    real = importlib.import_module

    def gone(name, *a):
        if name.startswith("gleaner.llm"):
            raise ImportError(name)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", gone)
    spec = importlib.util.spec_from_file_location("entry_alone", entry.__file__)
    alone = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(alone)
    assert not alone.HAS_LLM and not any(n.startswith("op") or n == "pipeline" for n in alone.queries())


def test_imports_without_a_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=entry.__file__.rsplit("/", 1)[0], capture_output=True, text=True, timeout=60)
    assert done.returncode == 0, done.stderr[-500:]
