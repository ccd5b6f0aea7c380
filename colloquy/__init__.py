"""Conversation analytics and record preparation on Spark DataFrames."""
