"""The registered corpus queries and their SQL."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from kpivane.llm import queries
from tests.support import DATA, differences, duck


def test_every_operator_is_registered_once():
    names = list(queries.QUERIES)
    assert [n.split("_")[0] for n in names if n.startswith("op")] and sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 14))
    assert len(names) == 13 and set(queries.SQL) <= set(names)
    assert {*names, "pipeline"} <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize(("name", "sf"), [("op2_minhash_near_dedup", "0.001"), ("op7_vector_near_dedup", "0.1"), ("op13_centroid_clusters", "0.1")])
def test_against_sql(spark, name, sf):
    path = f"{DATA}/sf{sf}"
    assert differences(queries.QUERIES[name](spark, path), duck(path), queries.SQL[name]) is None
