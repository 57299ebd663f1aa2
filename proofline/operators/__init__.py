"""DataFrame operators; each takes whole tables of many projects."""
