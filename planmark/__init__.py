"""Engineering-document analytics as DataFrame operators on Spark."""
