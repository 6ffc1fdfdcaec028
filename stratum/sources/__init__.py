"""Readers of inventories, record tables and containers; snapshot writers."""
