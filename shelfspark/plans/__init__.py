"""Plans: what has to be done to bring a catalog in line with a listing, and the rows that result."""
