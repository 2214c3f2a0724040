"""wattloom: interval-meter analytics and text-corpus preparation on Spark."""
