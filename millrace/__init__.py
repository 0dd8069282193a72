"""millrace: text and preference-data analytics as DataFrame programs on Spark."""

__version__ = "0.1.0"
