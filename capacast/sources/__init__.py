"""Reading and writing tables, declared schemas, and the test data bindings."""
