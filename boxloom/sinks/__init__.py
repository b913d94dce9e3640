"""Label files, data sets, submissions and reports."""
