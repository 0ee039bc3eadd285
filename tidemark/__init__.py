"""Review-change analytics as PySpark DataFrame operators.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns); no function creates a session or collects a fact table.
"""

__version__ = "0.1.0"
