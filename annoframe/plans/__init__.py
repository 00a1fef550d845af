"""Whole stages: measure, annotate, describe, background, caption. Each is one lazy plan."""
