"""ledgerlink: a PySpark-native engine that enriches, links and audits registry data."""
