"""DataFrame to DataFrame operators on stacks of fields and on series."""
