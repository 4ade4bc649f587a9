"""DataFrame -> DataFrame operators: ranks, statistics, matching, topics, models."""
