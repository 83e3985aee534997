"""Recipes, rules, inference, runs, evidence and reports."""
