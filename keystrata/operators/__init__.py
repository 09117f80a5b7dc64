"""Relational operators over keyed change logs: DataFrames in, DataFrames out."""
