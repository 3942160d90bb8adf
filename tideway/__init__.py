"""Packet-flow analytics and corpus preparation on Spark."""
