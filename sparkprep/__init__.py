"""Profile, clean and prepare distributed tables with Spark."""

from sparkprep.plans.catalogue import catalogue
from sparkprep.plans.batch import run_batch
from sparkprep.plans.preview import preview, sanitise, write_sample
from sparkprep.plans.profile import profile
from sparkprep.plans.recipe import Recipe, Step
from sparkprep.plans.runner import FittedRecipe, apply_recipe, fit_recipe
from sparkprep.plans.saved import load_fitted, save_fitted
from sparkprep.sources.order import with_row_numbers
from sparkprep.sources.tables import read_table, write_table

__all__ = [
    "FittedRecipe",
    "Recipe",
    "Step",
    "apply_recipe",
    "catalogue",
    "fit_recipe",
    "load_fitted",
    "preview",
    "profile",
    "read_table",
    "run_batch",
    "sanitise",
    "with_row_numbers",
    "save_fitted",
    "write_sample",
    "write_table",
]
