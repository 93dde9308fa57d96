"""The test-data views and the registered queries over them."""
