"""Operators put together: answering requests, judging the scorer."""
