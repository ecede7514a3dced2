"""roomrate — short-term-rental price analytics as lazy Spark DataFrame operators.

Sub-packages:
  sources    readers/writers and the role bindings onto the driver tables
  functions  column expressions (flags, currency, dates, text, bins)
  operators  DataFrame -> DataFrame operators (dedupe, period averages,
             neighbour fill, encoding, joins, profiling, splits, metrics, models)
  plans      composite jobs (calendar features, listing features, merge,
             training, exploration report, error report)
  streaming  request scoring on a batch table or a file stream
"""

__all__ = ["session", "constants"]
