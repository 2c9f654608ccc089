"""Sinks: payload tables, file/console/Kafka writers, HTTP delivery and fan-out."""
