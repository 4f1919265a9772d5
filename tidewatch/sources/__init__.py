"""Readers, writers and the adapters that turn raw tables into series, runs and graphs."""
