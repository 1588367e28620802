import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH", "")) if p)
os.environ.setdefault("DRIVER_MEMORY", "3g")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tracewright.session import local_session

    return local_session(4, 4, **{"spark__checkpoint__dir": str(tmp_path_factory.mktemp("shared"))})
