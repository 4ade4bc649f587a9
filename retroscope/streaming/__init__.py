"""The same projections on Structured Streaming inputs."""
