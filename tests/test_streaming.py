"""Streams over many files out of time order give what one file gives."""

import pytest

from corpusloom.streaming import queries as streams
from tests.compare import connection, differences

FILES = 20  # of which a batch takes at most eight


@pytest.mark.parametrize("name, source", [("stream_dedupe", "retrievals"), ("stream_sessions", "events"), ("stream_arm_counts", "retrievals")])
def test_stream_of_many_files(spark, small, tmp_path, name, source):
    con = connection(small)
    (tmp_path / f"{source}.parquet").mkdir()
    for i in range(FILES):  # the newest rows first; what was logged twice lies in the first and the last file
        some = f"SELECT * EXCLUDE (k) FROM (SELECT *, ntile({FILES}) OVER (ORDER BY ts DESC) - 1 AS k FROM {source}) WHERE k = {i}"
        if name == "stream_dedupe" and i == FILES - 1:
            some += f" UNION ALL SELECT * FROM (SELECT * FROM {source} WHERE ts IS NOT NULL ORDER BY ts DESC LIMIT 5)"
        con.execute(f"COPY ({some}) TO '{tmp_path}/{source}.parquet/{i:02d}.parquet' (FORMAT parquet)")
    assert differences(streams.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(streams.ORACLE[name]).df()) == []


def test_a_later_run_takes_new_files_only(spark, tmp_path):
    data, root = tmp_path / "data", str(tmp_path / "kept")
    schema = "element_id long, file_path string, elem_no int, text string"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(data / "elements.parquet"))
    add([(1, "a", 0, "uno"), (2, "a", 1, " "), (3, "a", 2, None)])
    assert [r.element_id for r in streams.stream_ingest(spark, str(data), root).collect()] == [1]
    add([(4, "b", 0, "cuatro")])
    out = streams.stream_ingest(spark, str(data), root)
    assert sorted(r.element_id for r in out.collect()) == [1, 4] and len(out.inputFiles()) == 2
