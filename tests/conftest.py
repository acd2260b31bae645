import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from catalume.session import session

    base = tmp_path_factory.mktemp("spark")
    s = session("tests", "local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_sql_warehouse_dir=str(base / "warehouse"), spark_checkpoint_dir=f"file://{base}/shared")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
