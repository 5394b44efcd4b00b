import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickloom.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", cores=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def walk(n, seed, symbol="AAA", start="2010-01-01"):
    """A seeded random walk of business-day bars with two-decimal prices."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(seed)
    close = np.round(100 + np.cumsum(rng.normal(0, 1, n)), 2).clip(5)
    open_ = np.round(close + rng.normal(0, 0.5, n), 2)
    high = np.round(np.maximum(open_, close) + rng.uniform(0, 1, n), 2)
    low = np.round(np.minimum(open_, close) - rng.uniform(0, 1, n), 2)
    return pd.DataFrame(
        {"symbol": symbol, "date": pd.bdate_range(start, periods=n).date, "open": open_, "high": high,
         "low": low, "close": close, "volume": 1000.0}
    )
