"""skein: a Spark-native engine for content analytics and recommendation data."""

__version__ = "0.1.0"
