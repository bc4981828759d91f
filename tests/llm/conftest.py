import pytest


@pytest.fixture
def docs(spark):
    def make(rows, schema="doc_id long, text string, row int, shard string, score string, ids string, label int, fp long"):
        names = [f.split()[0] for f in schema.split(", ")]
        return spark.createDataFrame([tuple(r) + (None,) * (len(names) - len(r)) for r in rows], schema)

    return make
