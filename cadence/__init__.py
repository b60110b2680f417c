"""cadence: a PySpark-native engine for repeated-cycle tables.

Every operator is a function from DataFrame to DataFrame (or to a Column
expression) whose work runs on Spark executors.  See README.md for the map
from operator ids (S1, P1, A1, W1, ...) to functions.
"""

from cadence.roles import ColumnRoles

__all__ = ["ColumnRoles"]
