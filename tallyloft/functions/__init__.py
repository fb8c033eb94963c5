"""Column functions: text, URLs, time, identity and scores."""
