"""tallyforge: generation-evaluation analytics as Spark jobs.

Every public function takes DataFrames (or Columns) and returns a DataFrame
(or a Column).  Most only describe a plan.  Those that rank or total within groups,
count their inputs or write scratch tables also run small Spark jobs while the plan
is built.
"""

__version__ = "0.1.0"
