"""Collaboration-network analytics as composable DataFrame operators."""
