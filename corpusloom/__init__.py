"""corpusloom: corpus linguistics and media-discourse analytics on PySpark."""
