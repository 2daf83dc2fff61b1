"""DataFrame operators. Columns are named by parameters; ``by`` holds the tenant columns."""
