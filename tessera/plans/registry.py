"""The register of queries and of the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(x: Column, places: int) -> Column:
    """The value of round(x, places); away from ties and in range without Spark's way through decimals and their digits."""
    scale = F.lit(10.0**places)
    near = F.rint(x * scale)
    return F.when((F.abs(x * scale - near) < 0.499) & (F.abs(near) < 1e12), near / scale + F.lit(0.0)).otherwise(F.round(x, places))


def query(sql: str | None = None, ctes: tuple[str, ...] = (), r: str = ""):
    """Registers a function under its name; ``r`` names double columns and the decimals that both sides round to."""
    places = {c: int(n) for c, n in (x.split(":") for x in r.split())}

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: rounded(F.col(c).cast("double"), n) for c, n in places.items()}) if places else df

        QUERIES[f.__name__] = run
        if sql:
            body = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
            if places:
                body = f"SELECT * REPLACE ({', '.join(f'round(CAST("{c}" AS DOUBLE), {n}) AS "{c}"' for c, n in places.items())}) FROM ({body})"
            ORACLES[f.__name__] = body
        return f

    return add
