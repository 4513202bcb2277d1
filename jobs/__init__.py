"""Jobs for the command line; each is a function of a session, paths and a small configuration."""
