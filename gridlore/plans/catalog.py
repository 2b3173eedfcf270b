"""Imports every module that registers queries."""

from gridlore.plans import arrays, experiments, files, ingest, models, velocity  # noqa: F401
