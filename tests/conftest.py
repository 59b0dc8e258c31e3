import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tripkit.sources import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    started = session(
        "tripkit-tests",
        shuffle_partitions=4,
        master="local[4]",
        driver_memory="4g",
        conf={
            "spark.ui.enabled": "false",
            # Whole plans, for the tests that look at them.
            "spark.sql.maxMetadataStringLength": "2000",
            "spark.sql.debug.maxToStringFields": "200",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    started.sparkContext.setLogLevel("ERROR")
    yield started
    started.stop()
