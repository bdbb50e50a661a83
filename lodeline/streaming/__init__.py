"""Structured Streaming: the batch operators on growing inputs."""
