import pytest

from evergrove.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    found = session(
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__showConsoleProgress="false",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__driver__memory="4g",
    )
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
