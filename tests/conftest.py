import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from folio.session import local_session, ship_package

    local = tempfile.mkdtemp(prefix="spark-")
    session = local_session("4", "4g", **{"spark.local.dir": local, "spark.sql.warehouse.dir": f"{local}/warehouse", "spark.sql.shuffle.partitions": "4"})
    yield ship_package(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
