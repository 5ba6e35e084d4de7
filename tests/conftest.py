import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from tessella.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    built = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('checkpoint')}"})
    built.sparkContext.setLogLevel("ERROR")
    return built
