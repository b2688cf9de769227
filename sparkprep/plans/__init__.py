"""Recipes, their execution, the profile, the preview and the batch job."""
