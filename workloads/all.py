"""Importing this module registers every query."""

from workloads import (  # noqa: F401
    country_panel, files, names_and_rows, pipelines, places, policies, predictors, statistics, survey_tables,
)
