import sys
from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from meterline.params import Params  # noqa: E402
from meterline.plans.book import Book  # noqa: E402
from meterline.session import build_session  # noqa: E402
from meterline.sources import schemas  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("local[8]", 8, "tests")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


AS_OF = date(2026, 4, 18)


@pytest.fixture
def make_book(spark):
    """A Book from short row lists; money may be given as int or str."""

    def make(contracts=(), usage=(), accounts=(("A1", "Acme", "BUILDING", "R1"),), reps=None, as_of=AS_OF, **extra):
        reps = reps or [("R1", "Rep One", "ASIA", "Enterprise"), ("R2", "Rep Two", "EUROPE", "Mid-Market")]
        frames = {
            "sales_reps": spark.createDataFrame(reps, schemas.SALES_REPS),
            "accounts": spark.createDataFrame(list(accounts), schemas.ACCOUNTS),
            "contracts": spark.createDataFrame([(*c[:4], Decimal(c[4]), c[5]) for c in contracts], schemas.CONTRACTS),
            "daily_usage_logs": spark.createDataFrame(
                [(i, a, d, Decimal(str(x))) for i, a, d, x in usage], schemas.DAILY_USAGE_LOGS
            ),
            **extra,
        }
        return Book(frames, Params(as_of=as_of))

    return make
