"""Ready-made queries; importing the package registers all of them."""

from . import history, preparing, privacy, synthesis, utility  # noqa: F401
from .registry import QUERIES, SQL, runner  # noqa: F401
