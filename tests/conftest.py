import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logsluice.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def lines_df(spark):
    """Build a line table from ``{path: [raw, ...]}`` or explicit source dictionaries."""
    from logsluice import schema as S

    def make(sources, kind="file"):
        rows = []
        for name, raws in sources.items():
            src = {f.name: None for f in S.SOURCE.fields}
            src["type"] = kind
            src["path" if kind == "file" else "pod"] = name
            rows += [(src, i, raw) for i, raw in enumerate(raws, 1)]
        return spark.createDataFrame(rows, S.LINE)

    return make
