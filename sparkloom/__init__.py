"""sparkloom: ranked retrieval, repository analytics and corpus preparation on Spark DataFrames."""
