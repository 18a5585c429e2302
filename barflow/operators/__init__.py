"""Relational operators over bars, quotes, trades and forecasts."""
