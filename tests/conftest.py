import datetime as dt

import pytest

from flightops.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="8g",
        spark__ui__enabled="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(n: int) -> dt.date:
    """n-th day of 2008."""
    return dt.date(2008, 1, 1) + dt.timedelta(days=n - 1)


def rows(df, *cols):
    """Rows as sorted tuples, nulls first."""
    picked = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
    return sorted(picked, key=lambda r: tuple((v is not None, v) for v in r))
