"""Every registered table query against its SQL, and what has none against what it must hold."""

import hashlib
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from quireflow.operators import rasters
from quireflow.plans import queries
from quireflow.sources import artefacts

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    clean = lambda x: None if x is None or x != x else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted((tuple(map(clean, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_counts_rows(spark):
    found = {r["metric"]: r["value"] for r in __spark_entry__.entry(spark).collect()}
    assert found["rows_total"] > 0 and found["rows_total"] == found["rows_ok"] + found["rows_review"]


def test_answers_are_parsed(spark):
    got = queries.QUERIES["q37_json_array"](spark, SF)
    whole = spark.read.parquet(f"{SF}/events.parquet").where("event_id % 5 < 3")
    assert got.count() == whole.count()
    assert got.where("cast(event_id as string) <> row_no").isEmpty()


def test_snapping_restores_names(spark):
    got = {r["p_partkey"]: r["article"] for r in queries.QUERIES["q38_wratio_snap"](spark, SF).collect()}
    names = queries.KNOWN_ARTICLES
    assert all(got[k] == names[k % len(names)] for k in got if k % 4 == 0 and names[k % len(names)] not in queries.text.CATEGORIES)


def test_kernels_see_ink(spark):
    got = {r["origin"]: r for r in queries.QUERIES["q36_image_kernels"](spark, SF).collect()}
    assert not got["part-7"]["likely_blank"] and got["part-7"]["ink_density"] > got["part-0"]["ink_density"]
    assert got["part-0"]["x"] >= 30 and got["part-0"]["y"] >= 50


def test_parts_of_one_row_group_are_drawn_on_all_cores_and_once(spark):
    query = queries.QUERIES["q36_image_kernels"](spark, SF)
    assert query.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert query._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 2


def test_cells_of_one_row_group_are_read_on_all_cores(spark):
    assert queries.QUERIES["q81_cell_readers"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_chosen_readings_ask_engines_once(spark):
    """The plan reads what engines answered; it asks none again."""
    plan = queries.QUERIES["q82_chosen_readings"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan


def test_overlays_show_a_line_each(spark):
    got = {r["origin"]: r["png_sha256"] for r in queries.QUERIES["q42_overlays"](spark, SF).collect()}
    parts = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_size").collect()
    assert len(got) == len(parts)
    for key, size in parts[:5]:
        line = {"kind": "row", "x0": 0, "y0": size % 48, "x1": 64, "y1": size % 48}
        assert got[f"part-{key}"] == hashlib.sha256(artefacts.png(artefacts.drawn_over(rasters.raster(key, size), [line]))).hexdigest()


def test_llm_part_can_be_missing(tmp_path):
    """Without the subpackage and the pipeline, the entry still imports and has the table queries."""
    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "quireflow", tmp_path / "quireflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(e.queries())[0])"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == [str(len(queries.QUERIES)), str(len(queries.SQL)), "q01_text_clean"], said.stderr


def test_a_missing_library_leaves_the_table_queries():
    code = "import sys; sys.modules['xxhash'] = None\nimport __spark_entry__ as e; print(len(e.queries()))"
    root = Path(__spark_entry__.__file__).parent
    said = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == [str(len(queries.QUERIES))], said.stderr
