from datetime import datetime, timedelta, timezone

import pytest

from eventloom.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="6g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def t0():
    return datetime(2026, 10, 31, 15, 0, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def after(t0):
    return lambda seconds: t0 + timedelta(seconds=seconds)


def rows(df, *columns):
    """Collected rows as sorted tuples; only for small fixtures."""
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


@pytest.fixture(scope="session")
def collect():
    return rows
