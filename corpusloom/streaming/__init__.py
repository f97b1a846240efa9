"""Flows over papers that keep arriving."""
