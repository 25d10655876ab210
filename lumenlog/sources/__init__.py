"""Sources: pushed bodies, landed files, syslog lines and polled log services."""
