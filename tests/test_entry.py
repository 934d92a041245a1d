"""The driver contract, streams, and that the core stands without the training subpackage."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from claimweave.streaming import incremental as I

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract():
    import __spark_entry__ as E

    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) > 180 and all(callable(f) for f in q.values())


def test_core_does_not_import_training():
    code = "import sys; import claimweave.plans.queries, claimweave.streaming.incremental; sys.exit(any(m.startswith('claimweave.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).limit(1).count() == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["A01_epistemic_fields", "A10_dispute_coverage", "J03_pair_sources", "J11_best_matches", "F05_quote_gate", "G05_merged_relations", "W07_running_share"])
def test_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as E

    con = duckdb.connect()
    for p in os.listdir(DATA):
        con.execute(f"CREATE VIEW {p.split('.')[0]} AS SELECT * FROM '{DATA}/{p}'")
    cur = con.execute(E.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    norm = lambda r: tuple(round(float(x), 5) if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in r)
    want = sorted(map(repr, map(norm, cur.fetchall())))
    got = sorted(map(repr, (norm(tuple(r[c] for c in cols)) for r in E.queries()[name](spark, DATA).collect())))
    assert got == want


def test_append_unseen_is_idempotent(spark, tmp_path):
    rows = [("n", "s", "q"), ("n", " s ", "q"), ("n", None, "q")]
    schema = "node_id string, source_id string, quote string"
    for k in range(2):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        I.append_unseen(spark, stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_windowed_counts(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-01 01:00:00' AS ts, 'a' AS k, 1.0D AS v UNION ALL SELECT timestamp'2024-01-05', 'a', 2.0D")
    df.write.parquet(str(tmp_path / "in"))
    out = I.windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "k", "v")
    out.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.schema("k string, n bigint, total double").parquet(str(tmp_path / "o")).agg(F.count("*")).first()[0] == 1
