"""Where graphs, query lists, op-logs and answers come from and go to."""
