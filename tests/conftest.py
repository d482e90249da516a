"""One local session for all tests, and a fixture of planted rings."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def planted(spark):
    """Cards in rings share an address and burst within three days; all other columns are drawn alike for both classes."""
    rng = random.Random(0)
    cards, rows = [], []
    for i in range(300):
        cards.append((10_000 + i, rng.randrange(100, 500), rng.randrange(0, 120), -1, rng.randint(2, 5)))
    for r in range(4):
        addr, day = 900 + r, rng.randrange(20, 100)
        cards += [(20_000 + 10 * r + j, addr, day, r, 4) for j in range(6)]
    for card, addr, day, ring, n in cards:
        mail, device = rng.choice(["a.com", "b.com", "c.com"]), rng.choice([None, "d1", "d2"])
        for _ in range(n):
            d = day + rng.randrange(0, 3 if ring >= 0 else 60)
            fraud = int(rng.random() < (0.98 if ring >= 0 else 0.02))
            rows.append([d * 86400 + rng.randrange(86400), round(rng.lognormvariate(4, 0.9), 2), card, float(addr), mail, device, float(d - day), fraud, ring])
    rng.shuffle(rows)
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "TransactionID bigint, TransactionDT bigint, TransactionAmt double, card1 bigint, addr1 double, P_emaildomain string, DeviceInfo string, D1 double, isFraud int, _ring_truth int",
    ).cache()
