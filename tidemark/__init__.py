"""tidemark: quality, drift and evaluation analytics for image-model datasets, on Spark.

Every public function takes and returns Spark ``DataFrame`` / ``Column`` objects;
nothing is collected unless its docstring says so and gives the bound.
"""

__version__ = "0.1.0"
