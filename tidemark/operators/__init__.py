"""DataFrame to DataFrame operators on captions."""
