"""Expressions and schema rules for claims-like tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cost columns in order of preference.
COST_COLUMNS = ("NETPAY", "TOTPAY", "PAY", "ALLOWED", "NETPAYAMT")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_code(c: str | Column) -> Column:
    """Upper case, trimmed, without dots."""
    return F.upper(F.regexp_replace(F.trim(col(c)), r"\.", ""))


def diagnosis_columns(df: DataFrame) -> list[str]:
    """DX1, DX2, ... in numeric order, then PDX, in whichever case they are written."""
    numbered = sorted((c for c in df.columns if re.fullmatch(r"DX\d+", c, re.I)), key=lambda c: int(c[2:]))
    out = numbered + [c for c in df.columns if c.upper() == "PDX"]
    if not out:
        raise ValueError("no diagnosis column")
    return out


def cost_column(df: DataFrame) -> str:
    by_name = {c.upper(): c for c in df.columns}
    for name in COST_COLUMNS:
        if name in by_name:
            return by_name[name]
    raise ValueError("no cost column")


def as_date(df: DataFrame, column: str) -> DataFrame:
    """``column`` as it is if it is a date or any timestamp, else cast to date."""
    kind = dict(df.dtypes)[column]
    return df if kind == "date" or kind.startswith("timestamp") else df.withColumn(column, F.to_date(column))


def in_years(date: str | Column, years: Iterable[int]) -> Column:
    """``year(date) in years`` as date ranges, which reach the Parquet scan; neighbouring years make one range."""
    years = sorted(set(years))
    if not years:
        return F.lit(False)
    runs: list[list[int]] = []
    for y in years:
        if runs and runs[-1][1] == y - 1:
            runs[-1][1] = y
        else:
            runs.append([y, y])
    day = lambda y: F.to_date(F.lit(f"{y:04d}-01-01")).cast("timestamp_ntz")
    return any_of([(col(date) >= day(a)) & (col(date) < day(b + 1)) for a, b in runs])


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def matches_any(columns: Sequence[str], test: Callable[[Column], Column], null_safe: bool = False) -> Column:
    """Whether ``test`` holds for any of the columns.

    In SQL's three-valued logic a row without a match and with a null column is NULL; ``null_safe``
    makes it false.
    """
    each = [test(F.col(c)) for c in columns]
    return any_of([F.coalesce(t, F.lit(False)) for t in each] if null_safe else each)


def in_any(columns: Sequence[str], codes: Sequence[str], null_safe: bool = False) -> Column:
    return matches_any(columns, lambda c: c.isin(list(codes)), null_safe)


def prefix_in_any(columns: Sequence[str], prefixes: Sequence[str], null_safe: bool = False) -> Column:
    return matches_any(columns, lambda c: any_of([c.startswith(p) for p in prefixes]), null_safe)


def code_regex(code: str) -> str:
    return "^" + re.escape(code.upper())


def disease_stage(columns: Sequence[str]) -> Column:
    """Stage 1 to 6 from codes N181..N186, 0 for N189; the first column that gives one."""
    one = lambda c: F.when(c == "N189", 0).otherwise(F.regexp_extract(c, r"N18([1-6]).*", 1).try_cast("int"))
    return F.coalesce(*(one(F.col(c)) for c in columns))


def rx_filter(df: DataFrame) -> Column:
    """Pharmacy rows: CLAIM_TYPE 'RX' if there is such a column, else RX not null if there is one, else all."""
    by_name = {c.upper(): c for c in df.columns}
    if "CLAIM_TYPE" in by_name:
        return F.col(by_name["CLAIM_TYPE"]) == "RX"
    if "RX" in by_name:
        return F.col(by_name["RX"]).isNotNull()
    return F.lit(True)


def deflated(cost: str | Column, year: Column, factors: dict[int, float]) -> Column:
    """Cost over its year's factor; NULL for other years."""
    chain = None
    for y, f in factors.items():
        chain = F.when(year == y, F.lit(float(f))) if chain is None else chain.when(year == y, F.lit(float(f)))
    return col(cost) / (F.lit(None).cast("double") if chain is None else chain)


def cost_stratum(cost: str | Column) -> Column:
    """0 below 50k, 1 to 100k, 2 to 200k, 3 from there."""
    c = col(cost)
    return F.when(c >= 200_000, 3).when(c >= 100_000, 2).when(c >= 50_000, 1).otherwise(0)


def cutoff_ladder(cost: str | Column, cutoffs: Sequence[int] = (50_000, 75_000, 100_000, 200_000, 300_000, 400_000, 500_000)) -> dict[str, Column]:
    """gt_<k>k flags; each implies those before it, as costs are compared with rising cutoffs."""
    return {f"gt_{k // 1000}k": F.coalesce((col(cost) > k).cast("int"), F.lit(0)) for k in cutoffs}


def safe_name(name: str) -> str:
    """A name of letters, digits and underscores."""
    return re.sub(r"_+", "_", re.sub(r"[^0-9A-Za-z_]", "_", str(name).strip())).strip("_")


def renamed(df: DataFrame, rule: Callable[[str], str] = safe_name) -> DataFrame:
    """All columns renamed by a rule in one projection; names that meet get a number."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        name = rule(c) or "_"
        seen[name] = seen.get(name, 0) + 1
        out.append(F.col(f"`{c}`").alias(name if seen[name] == 1 else f"{name}_{seen[name]}"))
    return df.select(*out)


def log_amount(c: str | Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(col(c).cast("double"), F.lit(0.0)), F.lit(0.0)))


def row_sum(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns]) if columns else F.lit(0)
