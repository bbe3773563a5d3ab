from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from panelwave.session import get_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "panelwave-tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    yield session


def synthetic_panel(n: int = 240, years: int = 6, seed: int = 5, tau: float = 0.5) -> pd.DataFrame:
    """Units with unit, year and covariate effects; cohorts 3 and 5 and never treated.
    The effect is ``tau`` in every treated year."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.normal(10, 2)
        w = rng.normal()
        cohort = int(rng.choice([0, 3, 5], p=_shares(x)))
        level = rng.normal(0, 1)
        for t in range(1, years + 1):
            on = int(cohort > 0 and t >= cohort)
            y = level + 0.2 * t + 0.05 * x * t + tau * on + rng.normal(0, 0.3)
            rows.append((i, i % 7, t, cohort or None, on, y, x + 0.01 * t, w, 4.0))
    cols = ["unit_id", "region", "year", "start_year", "treated", "y", "x", "w", "const"]
    return pd.DataFrame(rows, columns=cols)


def _shares(x: float) -> list[float]:
    a, b = np.exp(0.15 * (x - 10) - 0.7), np.exp(-0.1 * (x - 10) - 0.6)
    return [1 / (1 + a + b), a / (1 + a + b), b / (1 + a + b)]


@pytest.fixture(scope="session")
def panel_pd():
    return synthetic_panel()


@pytest.fixture(scope="session")
def panel(spark, panel_pd):
    rows = [
        tuple(None if pd.isna(v) else v for v in r) for r in panel_pd.itertuples(index=False, name=None)
    ]
    schema = (
        "unit_id long, region long, year int, start_year double, treated int, y double, x double, w double, const double"
    )
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("start_year", df["start_year"].cast("int")).cache()
