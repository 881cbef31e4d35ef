"""Ticks, watchers and their streaming adapter."""
