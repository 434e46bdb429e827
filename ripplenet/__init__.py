"""ripplenet: estimating vertex features of very large networks from small wave samples, on Spark."""
