"""An analytics engine for resolved yes/no questions and their predictions, on Spark."""
