"""Where findings go: syslog receivers, webhooks and spool files."""
