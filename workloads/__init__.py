"""The registered queries: the library run on the test tables, with their SQL."""
