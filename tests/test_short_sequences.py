"""Token selections against their SQL where sequences end early or lack tokens in the middle."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from oracle import TABLES, compare, duck

from tiltmeter.plans.registry import load_all

QUERIES = load_all()
ENDS_EARLY = "vec_id < 437"
GAPS = "vec_id < 437 AND vec_id * 7919 % 101 >= 14"


@pytest.fixture
def embeddings(tmp_path, sf_dir):
    """A folder with the given tables in which ``embeddings`` is the result of a SELECT from itself."""

    def write(select: str) -> str:
        for name in TABLES:
            (tmp_path / f"{name}.parquet").symlink_to(Path(sf_dir) / f"{name}.parquet")
        (tmp_path / "embeddings.parquet").unlink()
        connection = duckdb.connect()
        connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
        connection.execute(f"COPY ({select}) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
        return str(tmp_path)

    return write


def agrees(spark, name: str, folder: str) -> None:
    assert compare(spark, name, QUERIES[name], folder, duck(folder)) is None


@pytest.mark.parametrize("where", [ENDS_EARLY, GAPS])
def test_chunk_select(spark, embeddings, where):
    agrees(spark, "chunk_select", embeddings(f"SELECT * FROM embeddings WHERE {where}"))


@pytest.mark.parametrize("where", [ENDS_EARLY, GAPS])
def test_frame_select(spark, embeddings, where):
    agrees(spark, "frame_select", embeddings(f"SELECT * FROM embeddings WHERE {where}"))


def test_frames_that_are_copies(spark, embeddings):
    """Copies tie at a similarity of exactly 1 and stay by position; some are copies three times as long."""
    longer = "list_transform(b.embedding, lambda x: (x * 3)::FLOAT)"
    folder = embeddings(
        f"""SELECT a.vec_id, CASE WHEN a.vec_id % 90 > 9 AND a.vec_id % 5 = 1 THEN {longer} ELSE b.embedding END AS embedding, a.label
            FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id // 90 * 90 + a.vec_id % 10"""
    )
    agrees(spark, "frame_select", folder)


@pytest.mark.parametrize("where", [ENDS_EARLY, GAPS, "vec_id < 410", "vec_id < 411", "vec_id < 446"])
def test_pivot_select(spark, embeddings, where):
    agrees(spark, "pivot_select", embeddings(f"SELECT * FROM embeddings WHERE {where}"))


@pytest.mark.parametrize("where", [ENDS_EARLY, GAPS])
def test_random_select(spark, embeddings, where):
    agrees(spark, "random_select", embeddings(f"SELECT * FROM embeddings WHERE {where}"))


@pytest.mark.parametrize("where", [ENDS_EARLY, GAPS])
def test_staged_select(spark, embeddings, where):
    agrees(spark, "staged_select", embeddings(f"SELECT * FROM embeddings WHERE {where}"))
