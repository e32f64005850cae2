"""Registered queries, their input views and their oracle SQL."""
