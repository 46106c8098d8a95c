"""ledgerlens: registration, profiling and quality checks of financial files and tables on Spark."""
