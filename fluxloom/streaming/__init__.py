"""Structured Streaming forms of operators that can run on growing inputs."""
