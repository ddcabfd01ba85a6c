import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from loppis.session import local_session

    s = local_session("8", 2, spark__driver__memory="4g", spark__ui__showConsoleProgress="false", spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
