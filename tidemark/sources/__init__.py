"""Binary frames and segments, stored pairs, configuration files."""
