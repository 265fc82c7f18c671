"""Derived input views, the query catalogue and its SQL counterparts."""
