"""Routing tables and load balance, planned as small frames."""
