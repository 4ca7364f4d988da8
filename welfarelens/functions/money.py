"""Prices and currencies."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def conversion_factors(cpi_2017, cpi_2021, cpi_base, ppp_2017, ppp_2021) -> dict[str, Column]:
    """Survey currency to PPP of two base years, (CPI_t / CPI_base) / PPP_t, and their ratio."""
    f17 = F.try_divide(F.try_divide(col(cpi_2017), col(cpi_base)), col(ppp_2017))
    f21 = F.try_divide(F.try_divide(col(cpi_2021), col(cpi_base)), col(ppp_2021))
    return {
        "conversion_to_2017_ppp": f17,
        "conversion_to_2021_ppp": f21,
        "ratio_2021_to_2017": F.try_divide(f17, f21),
    }


def curated_factor(cpi, icp) -> Column:
    """1 / (cpi * icp) of a curated table."""
    return F.try_divide(F.lit(1.0), col(cpi) * col(icp))


def shortfall_to_population_gap(shortfall, headcount) -> Column:
    """Average shortfall among the poor to the population mean; 0 where nobody is poor."""
    return F.when(col(headcount) == 0, F.lit(0.0)).otherwise(col(shortfall) * col(headcount))


# fixed values: kilograms per unit label
UNIT_KILOGRAMS = {"50 KG. BAG": 50.0, "KILOGRAMME": 1.0, "90 KG. BAG": 90.0}


def price_per_50_kg(
    price: str | Column,
    quantity: str | Column,
    unit: str | Column,
    kilograms: Mapping[str, float] = UNIT_KILOGRAMS,
) -> Column:
    """Price of 50 kg from price, quantity (text of digits) and unit label; NULL if either is not usable."""
    weight = F.lit(None).cast("double")
    for label, kg in kilograms.items():
        weight = F.when(col(unit) == label, F.lit(kg)).otherwise(weight)
    units = F.when(col(quantity).rlike(r"^\d+$"), col(quantity).try_cast("double"))
    return F.try_divide(F.lit(50.0) * col(price), weight * units)


def deflator_column(df: DataFrame, pattern: str = "def_temp_prix") -> str:
    """The one column whose name holds ``pattern``."""
    found = [c for c in df.columns if re.search(pattern, c)]
    if len(found) != 1:
        raise ValueError(f"expected one column like {pattern!r}, found {found}")
    return found[0]


def single_factor(table: DataFrame, key: str, value, factor: str) -> float:
    """Factor of the only row with this key; any other number of rows is an error."""
    rows = table.filter(F.col(key) == value).select(factor).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected one row with {key} = {value!r}, found {'none' if not rows else 'several'}")
    return rows[0][0]


def deflated_consumption(
    df: DataFrame,
    total: str,
    household_size: str,
    factor: float | Column,
    deflator: str | None = None,
    out: str = "consumption_per_capita_per_day",
) -> DataFrame:
    """Annual household total to consumption per person and day in a common currency."""
    deflator = deflator or deflator_column(df)
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    return df.withColumn(
        out, F.try_divide(F.col(total) * f, F.col(household_size) * F.lit(365.0) * F.col(deflator))
    )


def year_label(year, base: int, currency: str = "USD") -> Column:
    """Name of the factor from a year's nominal currency to the base year's."""
    return F.concat(
        F.lit(f"conversion_factor_nominal_{currency}_"), col(year).cast("string"), F.lit(f"_to_{base}")
    )
