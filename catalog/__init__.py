"""Registered queries over the driver tables, with their SQL where one exists."""

from . import base, charts, checked, cleaning, growing, modelling, profiling, unsupervised  # noqa: F401  # isort: skip
from . import spread  # noqa: F401  # repeats queries of the others

QUERIES = base.QUERIES
SQL = base.SQL
