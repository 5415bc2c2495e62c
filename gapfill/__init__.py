"""Missing-value analytics for labelled text tables on Spark."""
