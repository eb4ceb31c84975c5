"""An analytics engine for time-stamped, conversation-like records on Spark."""
