"""ledgerline: analytics over event-like contract records, as composable Spark DataFrame operators."""
