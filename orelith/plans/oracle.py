"""The same queries as SQL for a second engine."""

from orelith.plans.oracle_core import SQL as CORE
from orelith.plans.oracle_general import SQL as GENERAL

SQL = GENERAL | CORE
