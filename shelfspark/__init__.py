"""Web-catalog page mining, text clean-up and publish-queue analytics on Spark."""

__version__ = "0.1.0"
