import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ledgerline.session import build_session, ship

    folder = str(tmp_path_factory.mktemp("shared"))
    session = build_session(
        master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__checkpoint__dir=folder,
        spark__sql__warehouse__dir=f"{folder}/warehouse", spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield ship(session)
    session.stop()
