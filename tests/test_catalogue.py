"""Every query of the catalogue against its SQL, on whole tables."""

import pytest

import corpusloom.plans.catalogue as C
from corpusloom.plans.oracle import ORACLE
from corpusloom.streaming import queries as streams
from tests.compare import connection, differences


@pytest.mark.parametrize("name", [n for n in C.queries() if n in ORACLE])
def test_query_equals_sql(spark, small, name):
    assert differences(C.queries()[name](spark, small).toPandas(), connection(small).execute(ORACLE[name]).df()) == []


@pytest.mark.parametrize("name", list(streams.queries()))
def test_stream_equals_batch_sql(spark, small, name):
    assert differences(streams.queries()[name](spark, small).toPandas(), connection(small).execute(streams.ORACLE[name]).df()) == []


def test_every_query_is_registered_once(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "hybrid_topk" in entry.queries()
