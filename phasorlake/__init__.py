"""phasorlake: a Spark-first engine for vector-symbolic analytics."""
