"""DataFrame → DataFrame operators (weighted estimates, household grain, income
bands, harmonization, quality checks). All lazy; nothing is collected."""
