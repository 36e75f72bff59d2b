import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewatch.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", "6g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def prices(spark):
    """Two assets of 400 days with a known slump, from a fixed rule."""
    return spark.sql("""
      SELECT asset, date_add(date'2021-01-01', d) AS date, c AS close, c * 0.999 AS open, c * 1.01 AS high, c * 0.99 AS low,
             1000D + (d * 37 % 101) AS volume, (1000D + (d * 37 % 101)) * c AS quote_volume,
             CAST(10 + d % 7 AS DOUBLE) AS trades, 400D + (d * 13 % 97) AS taker_buy_base
      FROM (SELECT a.asset, CAST(id AS INT) AS d,
              CAST(100 + 8 * sin(id / 9.0 + k) + (id * (31 + k) % 17) / 4.0 AS DOUBLE) * CASE WHEN id BETWEEN 200 AND 214 THEN pow(0.95D, id - 199) WHEN id > 214 THEN 0.6D ELSE 1D END AS c
            FROM range(400) CROSS JOIN (SELECT * FROM VALUES ('A', 0), ('B', 1) AS v(asset, k)) a)""")
