"""Candela: candle time series, news and signal analytics as Spark jobs."""
