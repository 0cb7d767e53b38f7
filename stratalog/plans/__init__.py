"""Looking at physical plans: what a query shuffles, broadcasts, reads and runs in Python."""
