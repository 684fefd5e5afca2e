"""newsprism: article-veracity analytics as Spark DataFrame, SQL and MLlib jobs."""

__version__ = "0.1.0"
