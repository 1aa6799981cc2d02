"""Statistical synthesizers: tables that look like a given one, with or without a
differential-privacy guarantee."""

from .fit import SYNTHESIZERS, fit_copula, fit_marginal, fit_tree  # noqa: F401
from .model import Model, load_model  # noqa: F401
from .private import fit_private_tree  # noqa: F401
