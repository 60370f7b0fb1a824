"""Spark jobs over large collections of agent-session transcripts."""
