"""DataFrame to DataFrame operators of survey tabulation."""
