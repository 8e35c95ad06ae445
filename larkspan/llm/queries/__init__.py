"""One thin query for each operator."""
