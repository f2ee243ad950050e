"""millrace: a retrieval, interval and corpus engine written as Spark DataFrame jobs."""
