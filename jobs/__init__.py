"""Jobs that run on given tables and write partitioned output; each has a command line and a config file."""
