"""marketloom: equity analytics and corpus preparation as Spark plans."""
