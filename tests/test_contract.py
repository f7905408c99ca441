"""The driver contract: every query of the engine runs, and its SQL has the same columns and rows."""

import importlib
import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from runloom.plans import catalogue
from runloom.schema import INLINE_CAP

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) and not math.isnan(value) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalogue.ORACLE_SQL:
        return
    done = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in done.fetchall())


@pytest.mark.parametrize("name", ["masked_context", "turn_rows", "retrieval_topm"])
def test_texts_beyond_the_cap_are_whole(spark, tmp_path, name):
    """The last word of each long text lies beyond INLINE_CAP; only whole texts show it and score by it."""
    long = "word " * INLINE_CAP
    rows = [(1, 0, "user", long + "needle"), (1, 1, "assistant", long + "other"), (1, 2, "user", None), (1, 3, "user", long + "NEEDLE"), (2, 0, "system", long + "s"), (2, 1, "user", "short")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    want = con.execute(catalogue.ORACLE_SQL[name]).df()[df.columns]
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in want.itertuples(index=False))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
LLM = os.path.join("runloom", "llm")


def in_a_copy(tmp_path, without, code):
    """What a program prints in a copy of the repository without some files and folders."""
    gone = {os.path.join(ROOT, x) for x in without}
    skip = lambda folder, names: [n for n in names if n in (".git", "__pycache__") or os.path.join(folder, n) in gone]
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "copy")})
    assert said.returncode == 0, said.stderr
    return said.stdout.split()


NAMES = "import __spark_entry__ as e; print(*sorted(e.queries()), '/', *sorted(e.oracle_sql()))"


@pytest.mark.parametrize("without", [[LLM, os.path.join("tests", "llm"), "corpus_pipeline.py"], [LLM, os.path.join("tests", "llm")]])
def test_the_engine_stands_without_the_corpus_operators(tmp_path, without):
    assert in_a_copy(tmp_path, without, NAMES) == [*sorted(catalogue.QUERIES), "/", *sorted(catalogue.ORACLE_SQL)]


def test_other_queries_run_without_the_corpus_operators(tmp_path):
    code = "from runloom.session import build_session; import __spark_entry__ as e; print('rows', e.entry(build_session(**{'spark.master': 'local[2]', 'spark.ui.enabled': 'false'})).count())"
    assert in_a_copy(tmp_path, [LLM, os.path.join("tests", "llm"), "corpus_pipeline.py"], code)[-2:] == ["rows", "15"]


@pytest.mark.skipif(not os.path.isdir(os.path.join(ROOT, LLM)), reason="the corpus operators have been removed")
def test_the_operators_stand_without_the_pipeline(tmp_path):
    names = in_a_copy(tmp_path, ["corpus_pipeline.py"], NAMES)
    assert "pipeline" not in names and {"op1_chat_format", "op10_simhash_near_dedup"} <= set(names)


@pytest.mark.skipif(not os.path.isdir(os.path.join(ROOT, LLM)), reason="the corpus operators have been removed")
def test_what_an_operator_lacks_is_an_error(tmp_path):
    """The guard is for modules that have been removed, not for what is missing within them."""
    code = "import sys; sys.modules['xxhash'] = None\nimport __spark_entry__ as e\ntry: e.queries()\nexcept ImportError as x: print('raised', x.name)"
    assert in_a_copy(tmp_path, [], code) == ["raised", "xxhash"]


def test_nothing_else_imports_the_corpus_operators():
    root = os.path.dirname(importlib.import_module("runloom").__file__)
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "runloom.llm" not in open(os.path.join(folder, n)).read()
