"""The country panel: one row per entity, compiled from yearly series and household surveys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from welfarelens.functions.money import conversion_factors, year_label
from welfarelens.operators import panel as P, poverty as V
from welfarelens.sources.readers import year_columns
from welfarelens.sources.writers import key_value


@dataclass
class PanelInputs:
    """Tables by role. All are keyed by ``entity``.

    poverty    price base -> series with reporting_year, headcount, poverty_gap
    surveys    one row per entity: survey_year, base_year
    at_survey  name -> (wide table, scale), read at the survey year
    latest     name -> (wide table, scale), last non-NULL year
    cpi, ppp   wide tables for the conversion factors
    overrides  curated factors (conversion_to_2017_ppp, conversion_to_2021_ppp), weakest first
    households entity, outcome, weight
    lines      price base -> poverty line
    """

    poverty: Mapping[str, DataFrame]
    surveys: DataFrame
    cpi: DataFrame
    ppp: DataFrame
    at_survey: Mapping[str, tuple[DataFrame, float]] = field(default_factory=dict)
    latest: Mapping[str, tuple[DataFrame, float]] = field(default_factory=dict)
    overrides: Sequence[DataFrame] = ()
    households: DataFrame | None = None
    lines: Mapping[str, float] = field(default_factory=lambda: {"2017": 2.15, "2021": 3.0})


def compile_panel(inputs: PanelInputs, base_columns: tuple[str, str] = ("2017", "2021")) -> DataFrame:
    """Join everything into one row per entity.

    Each input is reduced to one row per entity before its join, and all joins are
    on the entity, so a table is shuffled at most once.
    """
    out = inputs.surveys
    for base, series in inputs.poverty.items():
        latest = P.latest_row(series, "entity", "reporting_year", ["headcount", "poverty_gap"]).select(
            "entity",
            F.col("latest_headcount").alias(f"poverty_rate_{base}_most_recent"),
            F.col("latest_headcount_year").alias(f"poverty_rate_{base}_most_recent_year"),
            F.col("latest_poverty_gap").alias(f"poverty_gap_{base}_most_recent"),
        )
        out = out.join(latest, "entity", "left")
        at = P.estimate_at_year(
            inputs.surveys.filter(F.col("survey_year").isNotNull()).select("entity", "survey_year"),
            "entity", "survey_year", series, "entity", "reporting_year", ["headcount", "poverty_gap"],
        ).select(
            "entity",
            F.col("headcount").alias(f"poverty_rate_{base}_survey_year"),
            F.col("poverty_gap").alias(f"poverty_gap_{base}_survey_year"),
            F.col("method").alias(f"method_{base}"),
        )
        out = out.join(at, "entity", "left")
    for name, (wide, scale) in inputs.at_survey.items():
        out = P.lookup_year(out, "entity", "survey_year", wide, "entity", name, scale)
    for name, (wide, scale) in inputs.latest.items():
        recent = P.latest_non_null(wide, name, scale=scale).select("entity", name, f"{name}_year")
        out = out.join(recent, "entity", "left")
    out = add_conversion_factors(out, inputs.cpi, inputs.ppp, inputs.overrides, base_columns)
    if inputs.households is not None:
        out = out.join(survey_poverty(inputs.households, out, inputs.lines), "entity", "full")
    return out


def add_conversion_factors(
    panel: DataFrame, cpi: DataFrame, ppp: DataFrame, overrides: Sequence[DataFrame], base_columns: tuple[str, str]
) -> DataFrame:
    """Survey currency to PPP of two base years, replaced by curated factors where there are any."""
    years = year_columns(cpi)
    a, b = base_columns
    table = cpi.select("entity", *[F.col(f"`{y}`").cast("double") for y in years])
    side = ppp.select("entity", F.col(f"`{a}`").alias("__pa"), F.col(f"`{b}`").alias("__pb"))
    joined = panel.join(table, "entity", "left").join(side, "entity", "left")
    joined = joined.withColumn("__base", P.value_at_fractional_year("base_year", years, {2024: 2023}))
    factors = conversion_factors(F.col(f"`{a}`"), F.col(f"`{b}`"), "__base", "__pa", "__pb")
    out = joined.withColumns(factors).drop("__pa", "__pb", "__base", *years)
    pair = {c: c for c in ("conversion_to_2017_ppp", "conversion_to_2021_ppp")}
    for curated in overrides:
        out = P.override_from(out, curated, "entity", pair)
    return out.withColumn(
        "ratio_2021_to_2017", F.try_divide("conversion_to_2017_ppp", "conversion_to_2021_ppp")
    )


def survey_poverty(households: DataFrame, panel: DataFrame, lines: Mapping[str, float]) -> DataFrame:
    """Rate and gap index of each entity's survey at both lines; the first line sees converted outcomes.

    Entities that the panel does not have, or that have no factor, are NULL at the first line.
    """
    factor = panel.select("entity", F.col("ratio_2021_to_2017").alias("__f"))
    (first, z1), (second, z2) = lines.items()
    out = V.survey_metrics(
        households.join(factor, "entity", "left"), "outcome", "weight", "entity",
        {first: (z1, "__f"), second: (z2, None)},
    )
    return out.withColumnsRenamed({c: f"survey_{c}" for c in out.columns if c != "entity"})


def currency_table(panel: DataFrame) -> DataFrame:
    """The conversion factors of the entities that have a survey."""
    return panel.filter(F.col("survey_year").isNotNull()).select(
        "entity", F.col("conversion_to_2021_ppp").alias("conversion_factor")
    )


def secondary_indicators(gdp: DataFrame, cpi: DataFrame, entities: Mapping[str, object], reference: object,
                         first_year: int, base_year: int, price_year: int) -> DataFrame:
    """(indicator, value) rows: GDP of some entities in base-year prices and the reference's price factors.

    ``gdp`` and ``cpi`` are wide tables keyed by entity.
    """
    own = cpi.filter(F.col("entity") == reference)
    scale = own.agg((F.max(f"`{base_year}`") / F.max(f"`{price_year}`")).alias("__s"))
    scaled = gdp.crossJoin(F.broadcast(scale))
    scalars = {
        f"{name}_GDP_{base_year}": F.max(F.when(F.col("entity") == code, F.col(f"`{base_year}`") * F.col("__s"))) / 1e9
        for name, code in entities.items()
    }
    totals = key_value(scaled, scalars)
    years = [y for y in year_columns(cpi) if int(y) >= first_year]
    long = own.select("entity", *[F.col(f"`{y}`") for y in years])
    long = P.to_long(long, ["entity"], "value")
    factors = P.index_to_base_year(long, "year", "value", base_year).select(
        year_label("year", base_year).alias("indicator"), "value"
    )
    return totals.unionByName(factors)
