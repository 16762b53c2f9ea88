"""Readers: tables by name, adapters from plain tables to conversation rows."""
