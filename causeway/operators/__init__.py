"""DataFrame -> DataFrame operators. Each takes `scope`, the columns that tell incidents apart."""
