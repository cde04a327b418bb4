"""Tables that are folders of files, as larger ones are."""

import pytest

from skeinworks.queries import ORACLE, QUERIES
from tests.compare import same


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("folders"))
    for name in ("documents", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(3).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.mark.parametrize("name", ["st07_stream_of_changes", "st08_cursor"])
def test_streams_read_folders(spark, folders, name):
    same(QUERIES[name](spark, folders), ORACLE[name], folders)


@pytest.mark.parametrize("name", ["k01_committed_writes", "k02_counts_by_schema", "st04_first_of_run", "st_windowed"])
def test_streamed_halves_come_from_folders(spark, folders, name):
    same(QUERIES[name](spark, folders), ORACLE[name], folders)
