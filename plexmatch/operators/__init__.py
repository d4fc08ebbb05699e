"""Graph operators: matching, counting, candidates, rank, vertex programs."""
