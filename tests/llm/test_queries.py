"""The queries against their SQL, and the classifier against labels it hasn't seen."""

import os

import pytest

from attestra.llm.registry import ORACLE_SQL, QUERIES
from tests.compare import SF, assert_same, connect

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert_same(df, connect(), ORACLE_SQL[name])
    else:
        assert df.count() >= spark.read.parquet(f"{SF}/documents.parquet").count()


def test_held_out_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op8_quality_classifier"](spark, SF).where("held_out").join(labels, "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.9
