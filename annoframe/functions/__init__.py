"""Column expressions: everything here returns a Column and stays inside generated code where Spark can."""
