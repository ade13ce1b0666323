"""keystrata: a log-structured keyed-record engine expressed as Spark plans."""
