"""starledger — a Spark-native sales & supply-chain analytics library.

Star-schema model (dimensions + facts as DataFrames), the revenue waterfall
as composable views, parameterised reports, and incremental maintenance jobs,
all expressed with the DataFrame API so Catalyst/AQE plan the execution.
"""

from starledger.sources.star import SalesModel, build_star, derive_star, load_star, materialize_star

__all__ = ["SalesModel", "build_star", "derive_star", "load_star", "materialize_star"]
