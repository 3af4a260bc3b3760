import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ELSEWHERE = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from countgrove.shipping import ship
ship(spark)
def loads(batches):
    import countgrove.plans.pair_blocks as p
    for b in batches:
        yield b.assign(id=len(p.__file__))
print("rows", spark.range(3).mapInPandas(loads, "id long").count())
spark.stop()
"""


def test_entry_and_registry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "hill_1" in df.columns
    names = set(entry.queries())
    assert len(names) > 150
    assert {n for n, (_, sql) in entry._cases().items() if sql} <= names


@pytest.mark.parametrize("gone", [["countgrove.llm", "corpus_pipeline"], ["regex"], ["xxhash"], ["public_tokenizers"]])
def test_missing_query_modules_leave_the_rest(gone):
    """Without the optional folders, or what only they need, the entry module still imports and lists the other queries."""
    root = str(Path(__file__).resolve().parents[1])
    code = (f"import sys; sys.path.insert(0, {root!r}); sys.modules.update(dict.fromkeys({gone!r}))\n"
            "import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n.startswith('op')])")
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[0]) > 150 and "op1_" not in done.stdout


def test_workers_find_the_shipped_package(tmp_path):
    """A session in another folder, whose workers do not have the package on their path."""
    root = str(Path(__file__).resolve().parents[1])
    env = {**{k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", ELSEWHERE.format(root=root)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=180)
    assert "rows 3" in done.stdout, done.stderr[-2000:]


def test_rounding_equals_written_digits(spark):
    """Digits are found by arithmetic, not by a formatter; both give the same doubles."""
    import numpy as np

    from catalog import registry

    rng = np.random.default_rng(4)
    values = [*(rng.standard_normal(3000) * 10.0 ** rng.integers(-13, 24, 3000)), *(rng.integers(-10 ** 6, 10 ** 6, 2000) / 64),
              *10.0 ** np.arange(-11, 23), 0.0, 99999999.5, 9999999.95]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(-1, None)], "i long, v double")
    for digits in (6, 8):
        out = registry.significant(df, digits)
        got = {r.i: r.v for r in out.collect()}
        assert got[-1] is None and all(got[i] == (0.0 if abs(v) < 1e-12 else float(f"{v * registry.NUDGE:.{digits - 1}e}")) for i, v in enumerate(values))
