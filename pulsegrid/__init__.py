"""pulsegrid: event-timeline and chart-corpus analytics as PySpark DataFrame operators."""
