"""Kill markers find their file by containment, among those only interrupted at that time."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import telemetry as T

LOG = [
    ("topics/A/guía 3 (1).pdf", "failed", "Interrumpido por el vigilante", 1),
    ("topics/A/x.pdf", "processing", None, 2),
    ("topics/A/roto.pdf", "processing", None, 3),
    ("topics/A/roto.pdf", "failed", "contraseña requerida", 4),
    ("topics/A/hecho-largo.pdf", "failed", "Interrumpido por el vigilante", 5),
    ("topics/A/hecho-largo.pdf", "success", None, 6),
    ("topics/A/", "processing", None, 7),
]


@pytest.fixture(scope="module")
def spells(spark):
    at = dt.datetime(2025, 1, 1)
    rows = [(i, p, s, None, "A", e, 0, f"2025-01-01T00:00:{i:02d}", at + dt.timedelta(seconds=i)) for p, s, e, i in LOG]
    return T.interrupted_spells(spark.createDataFrame(rows, "state_id long, path string, status string, hash string, topic string, error string, retry_count int, timestamp string, logged_at timestamp")).localCheckpoint()


@pytest.mark.parametrize(
    "context, second, want",
    [
        ("extract guía 3 (1).pdf page 3", 9, "topics/A/guía 3 (1).pdf"),
        ("docling_convert_x.pdf", 9, "topics/A/x.pdf"),
        ("docling_convert_roto.pdf", 9, None),
        ("docling_convert_roto.pdf", 3, "topics/A/roto.pdf"),
        ("docling_convert_hecho-largo.pdf", 5, "topics/A/hecho-largo.pdf"),
        ("docling_convert_hecho-largo.pdf", 9, None),
        ("docling_convert_y.pdf", 9, None),
        ("x", 9, None),
        ("", 9, None),
        (None, 9, None),
    ],
)
def test_marker_names_its_file(spark, spells, context, second, want):
    at = dt.datetime(2025, 1, 1) + dt.timedelta(seconds=second)
    markers = spark.createDataFrame([(1, context, at, at, 99)], "marker_id long, context string, at timestamp, logged_at timestamp, state_id long")
    got = T.kill_attribution(markers.select("marker_id", "context", F.struct("at", "logged_at", "state_id").alias("since")), spells).collect()
    assert [r.path for r in got] == ([want] if want else [])
