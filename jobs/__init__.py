"""Runnable jobs over the library: each is a function of a session and plain paths, with a command line and a config file."""
