from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from driftline.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        4, "driftline-tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"}
    )
    session.conf.set("spark.sql.session.timeZone", "UTC")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def flowers():
    """150 rows of four measurements and a label, like the classic flower table."""
    rng = np.random.default_rng(0)
    parts = []
    for i, name in enumerate(["setosa", "versicolor", "virginica"]):
        centre = np.array([5.0 + i * 0.8, 3.4 - i * 0.3, 1.5 + i * 2.0, 0.3 + i * 0.8])
        part = pd.DataFrame(
            rng.normal(centre, 0.3, (50, 4)).clip(0.1),
            columns=["sepal_length", "sepal_width", "petal_length", "petal_width"],
        )
        parts.append(part.assign(species=name))
    return pd.concat(parts, ignore_index=True).rename_axis("id").reset_index()


def rows(df):
    return [tuple(r) for r in df.collect()]
