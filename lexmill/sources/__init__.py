"""Where documents, lines and patterns come from, and where results go."""
